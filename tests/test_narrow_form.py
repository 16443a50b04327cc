"""A query on some statistics builds the form of these alone, and the same numbers."""

from compare import SMALL
from pyspark.sql import functions as F

from foreslate.catalog import REGISTRY, frames
from foreslate.sources.fixtures import Fixture


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_form_of_some_statistics_is_the_full_tables(spark):
    fx = Fixture(spark, SMALL)
    narrow = REGISTRY["j5_feature_assembly"].build(fx)
    assert not {"form", "team_games", "halves"} & set(fx.__dict__["_shared"])
    full = frames.paired(fx).select(narrow.columns)
    assert narrow.count() == full.count() > 0
    assert _rounded(narrow).exceptAll(_rounded(full)).isEmpty()
    assert set(REGISTRY["j5_feature_assembly"].build(fx).columns) == set(full.columns)


def test_linear_fits_read_a_part_of_the_feature_table(spark):
    fx = Fixture(spark, SMALL)
    fx.__dict__["_shared"] = {}
    part = frames.model_inputs(fx)
    assert "halves" not in fx.__dict__["_shared"] and "home_off_epa_play" not in part.columns
    full = frames.features(fx).select(part.columns)
    assert part.count() == full.count() > 0
    assert _rounded(part).exceptAll(_rounded(full)).isEmpty()


def test_tables_on_the_way_to_the_feature_table_are_deleted(spark):
    """Scans, ratings and terms used to stay beside the table they led to."""
    import os

    from foreslate.sources import store

    def kept():
        folder = store.run_folder(spark).removeprefix("file://").removeprefix("file:")
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()

    fx = Fixture(spark, SMALL)
    fx.__dict__["_shared"] = {}
    inputs = fx.games, frames.team_games(fx), fx.player_weeks  # noqa: F841 - made before, and kept
    before = kept()
    table = frames.model_inputs(fx)
    assert [name.rsplit("-", 1)[0] for name in kept() - before] == ["frame"]
    assert table.count() == fx.games.count()
