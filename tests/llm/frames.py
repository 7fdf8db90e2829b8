"""Small inputs with every awkward row, and brute-force versions to hold results against."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
# Columns whose names the operators use inside.
CLASHING = ["block", "part", "kind", "counts", "shingles", "component", "score", "w", "h", "hash", "_id", "_kept", "words", "set_id"]


def words(text):
    return (text or "").encode().split()


def lowered(text):
    return (text or "").encode().lower().split()


def odd_documents(spark):
    """Null and repeated ids, null, empty, blank, short, very long, repeated and control-character texts."""
    passage = " ".join(f"p{i}" for i in range(60))
    long_text = " ".join(f"w{i % 9973}x{i}" for i in range(8_000))
    near = [f"n{i}" for i in range(200)]
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one two three"), (5, "One two\tTHREE"), (6, passage), (7, f"before {passage} after"),
        (8, long_text), (9, long_text + " tail"), (10, "a " * 300), (11, "Ärger ärger   x\x1cy <|endoftext|> z"), (12, "same row"), (12, "same row"),
        (13, " ".join(near)), (14, " ".join(near[:195])), (15, " ".join(near[5:])), (16, "x" * 100_000), (None, "no id here at all"), (-3, "negative id text"),
        (20, "  leading and  double   spaces \r\n and lines\n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({name: F.lit("extra") for name in CLASHING})


def no_documents(spark):
    return odd_documents(spark).where("false")


def shingle_set(text, n=5):
    w = lowered(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, percent=80):
    """[(doc_id, n_shingles, component_id)] for rows (doc_id, text), by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def brute_kept(rows, window=35):
    """[(doc_id, n_words, removed places, kept words)] for rows (doc_id, text)."""
    seen = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in rows:
        w = words(text)
        covered = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c)))
    return out


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
