"""Secret scans over a ledger of content-addressed blobs.

Native: DataFrame functions only.  Every version of every path is recorded as
(path, blob); a blob is scanned once for each version of each rule; findings
belong to blobs and are joined back to all paths that hold them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.store import materialize, scratch_path
from .common import documents, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and non-overlapping; a match counts if group ``group``
    of it has ``least`` characters.  ``rank`` orders kinds that start at one place.
    A changed pattern needs a new ``version``: blobs are then scanned again for this rule alone.
    """

    kind: str
    version: int
    rank: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds.  Runs that are too short can't begin inside a longer run of
# the last two kinds, so their length is part of the pattern; an assignment that is too
# short still hides what it covers, so it is matched first and dropped afterwards.
RULES = (
    Rule("assign", 1, 0,
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, 2, r"[0-9a-f]{16,}"),
)

SCANS = "blob binary, rule string"
FINDINGS = "blob binary, rule string, start int, stop int"
VERSIONS = "path_id bigint, blob binary, run string"


def _hits(text: Column, rule: Rule) -> Column:
    """Array of (rule, gap, length, good) per match: gap is the text since the match before."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def hit(match: Column, at: Column) -> Column:
        good = F.lit(True)
        if rule.group or rule.least > 1:
            good = F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least
        return F.struct(
            F.lit(rule.key).alias("rule"), at.alias("i"), F.length(F.get(gaps, at)).alias("gap"),
            F.length(match).alias("len"), good.alias("good"))

    return F.when(text.rlike(rule.pattern), F.transform(whole, hit))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (blob, rule, start, stop) of ``blobs`` (blob, text, todo: rule keys still unseen).

    Positions are code points; they are running sums of the gaps between matches and the
    matches themselves, so a text with many matches costs no more than its length.
    """
    found = F.flatten(F.filter(F.array(*[
        F.when(F.array_contains("todo", r.key), _hits(F.col("text"), r)) for r in rules
    ]), lambda hits: hits.isNotNull()))
    order = Window.partitionBy("blob", "rule").orderBy("i")
    return (
        blobs.select("blob", F.explode(found).alias("hit")).select("blob", "hit.*")
        .withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(order).cast("int"))
        .where("good").select("blob", "rule", (F.col("stop") - F.col("len")).alias("start"), "stop")
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


class Ledger:
    """Three growing tables under one shared path: versions, scans, findings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        return _stored(self.spark, f"{self.path}/{name}", schema)

    @property
    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    @property
    def scans(self) -> DataFrame:
        return self._table("scans", SCANS)

    @property
    def findings(self) -> DataFrame:
        """Distinct, as a run that was broken off may have stored some twice."""
        return self._table("findings", FINDINGS).distinct()

    def record(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> str:
        """Add ``paths`` (path_id, text) and scan what is new; returns the run's name.

        Findings are stored before the pairs that vouch for them: if a run
        breaks off between the two, the next one scans those blobs again.
        """
        run = uuid.uuid4().hex
        addressed = paths.select("path_id", "text", F.unhex(F.sha2("text", 256)).alias("blob"))
        addressed.select("path_id", "blob", F.lit(run).alias("run")).write.mode("append").parquet(
            f"{self.path}/versions")
        keys = F.array(*[F.lit(r.key) for r in rules])
        known = self.scans.groupBy("blob").agg(F.collect_set("rule").alias("known"))
        left_over = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
        named = self.versions.where(F.col("run") == run).select("blob").distinct()
        new = named.join(known, "blob", "left").select("blob", left_over.alias("todo")).where(F.size("todo") > 0)
        # one text per blob: combined before the shuffle, so thousands of copies cross it once a task
        blobs = addressed.groupBy("blob").agg(F.first("text").alias("text")).join(new, "blob")
        scan_blobs(blobs, rules).write.mode("append").parquet(f"{self.path}/findings")
        new.select("blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{self.path}/scans")
        return run

    def report(self, run: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Findings of one run, joined back to every path: path_id and an array of spans.

        The spans are stored per blob first, so that both sides of the join
        are plain shuffles and Spark can split a blob that a third of all paths hold.
        """
        rank = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.rank))])
        kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
        spans = (
            self.findings.where(F.col("rule").isin([r.key for r in rules]))
            .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
                "start", rank[F.col("rule")].alias("rank"), "stop", kind[F.col("rule")].alias("kind")))).alias("spans"))
        )
        spans = materialize(spans, "spans")
        paths = self.versions.where(F.col("run") == run).select("path_id", "blob")
        return paths.join(spans, "blob", "left").select(
            "path_id", F.coalesce("spans", F.array().cast(
                "array<struct<start:int,rank:int,stop:int,kind:string>>")).alias("spans"))


def scan_secrets(docs: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per input row: id and its spans, from the ledger.

    Null text is an empty blob.  Rows that repeat an id are versions of one
    path; each gives a row.  A null id is a path without a name.  No rows give no rows.
    Other columns, of whatever name, are not read.
    """
    paths = docs.select(F.col(id_col).alias("path_id"), text_or_empty(text_col).alias("text"))
    return ledger.report(ledger.record(paths, rules), rules).withColumnRenamed("path_id", id_col)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir), Ledger(spark, scratch_path(spark, "ledger")))
    names = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.array_join(names, ",").alias("spans")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


QUERIES = {"op3_secret_scan": op3_secret_scan}

ORACLE_SQL = {"op3_secret_scan": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(kind, rank, pat) AS (VALUES
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+')),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, regexp_extract_all(t, (SELECT pat FROM k WHERE rank = 0), 0) AS hit,
         regexp_extract_all(t, (SELECT pat FROM k WHERE rank = 0), 2) AS part,
         string_split_regex(t, (SELECT pat FROM k WHERE rank = 0)) AS gap FROM d
  UNION ALL SELECT doc_id, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), NULL, string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, regexp_extract_all(t, '[0-9a-f]+'), NULL, string_split_regex(t, '[0-9a-f]+') FROM d
), u AS (
  SELECT doc_id, kind, rank, unnest(hit) AS h, unnest(coalesce(part, hit)) AS p, unnest(gap[1:len(hit)]) AS g,
         generate_subscripts(hit, 1) AS i FROM m WHERE len(hit) > 0
), s AS (
  SELECT *, (sum(length(g) + length(h)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop FROM u
), f AS (
  SELECT doc_id, kind, rank, stop - length(h) AS start, stop FROM s
  WHERE length(p) >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 ELSE 16 END
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
""".replace("\\x20", "\x20")}
