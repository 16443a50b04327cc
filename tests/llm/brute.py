"""Small tables with awkward rows, and plain Python twins of the operators."""

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = r"[\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def awkward(spark, texts, first_id=0):
    """Documents of the texts, with null and repeated rows and columns of clashing names."""
    rows = [(first_id + i, t, ("en", "de")[i % 2], None if i % 3 else "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "row", "ids", "hits", "items", "score", "block", "node", "n", "__norm", "kept", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df


def words_like(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts(seed=5):
    rng = random.Random(seed)
    base = " ".join(words_like(rng, 60))
    return [
        None, "", " ", "\n\t ", "a", "A", "é ü\nß", base, base, base.replace(" ", "\n", 1), base.upper(),
        "x" * 5000, "\\<|im_start|>\\", "日本 語", "0", base + " tail", "  " + base, None, "",
    ]


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else ({tuple(w)} if w else set())


def similar(texts, size, p, q):
    """{id: (set size, component, links)} by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    of = components(sets, links)
    return {i: (len(s), of[i], sum(i in x for x in links)) for i, s in sets.items()}


def repeats(rows, length=50):
    """{id: (bytes, removed, spans, kept)} of suffix dedup; rows of (id, text), ids distinct."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            if first.setdefault(data[k:k + length], i) < i:
                gone[k:k + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, kept)
    return out


def benchmark_hits(texts, items, window=10):
    """{id: (words, hit words, items)}; items of (id, text)."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = {}
    for item, text in items:
        w = re.findall(pattern, lower(text or ""))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = {}
    for i, text in texts.items():
        w, hit, found = re.findall(pattern, lower(text or "")), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                own = wins.get(tuple(w[k:k + n])) if k + n <= len(w) else None
                if own:
                    hit |= set(range(k, k + n))
                    found |= {str(x) for x in own if x is not None}
        out[i] = (len(w), len(hit), sorted(found))
    return out
