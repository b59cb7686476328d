"""Divergence audit, ball k-means and decontamination: plain versions, odd rows, several blocks and passes."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import ball_kmeans, decontamination, divergence, queries
from tests.conftest import duck, same_rows

# 11 --------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string"


def _plain_audit(rows, top):
    docs = [((lang or ""), (source or ""), [w for w in "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text or "").split(" ") if w]) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= 3]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if df[w] >= 3)
        whole = sum(counts.values(), Counter())

        def share(c):
            return {t: 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, listed in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                for rank, (value, item) in enumerate(sorted(listed, key=lambda x: (x[0], x[1].encode())), 1):
                    out.add((lang, s, part, item, -value, rank))
    return out


def _odd_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "éa", "éb", "東京", "a" * 300 + "x", "a" * 300 + "y", "aa", "ab", "abc", "\U0001f600", "zz"]
    rows = [(i, " 1-".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", None])) for i in range(60)]
    rows += [(1, "same same same", "en", "copies")] * 5  # repeated rows
    rows += [(70, None, "en", "silent"), (71, "", "xx", "a"), (72, "only once", "xx", "b"), (None, None, None, None), (73, "bulk " * 50_000, "en", "long")]
    return rows


@pytest.mark.parametrize(("top", "digit_bits", "direct"), [(200, 12, 4096), (3, 12, 4096), (3, 7, 0), (1, 5, 0)])
def test_divergence_against_a_plain_version(spark, top, digit_bits, direct):
    rows = _odd_rows()
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("term", "item", "value", "n", "p", "q", "part", "rank", "high", "need"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = {tuple(r) for r in divergence.audit(docs, top=top, digit_bits=digit_bits, direct=direct).collect()}
    assert found == _plain_audit(rows, top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_tasks_hand_on_bounded_counts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    rows = _odd_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows]) for k in (2, 3, 1)], ["lang", "source", "text"])
    summed = Counter()
    for out in divergence._counted(iter([batch])):
        for r in out.to_pylist():
            summed[r["lang"], r["source"], r["term"]] += r["n"]
    whole = Counter()
    for _, text, lang, source in rows:
        whole.update((lang or "", source or "", t.decode()) for t in divergence._term.findall((text or "").encode().lower()))
    assert summed == whole


def test_largest_by_bits_and_bytes(spark):
    rng = random.Random(2)
    rows = [(g, f"{rng.randint(0, 10**6):x}" + "é" * rng.randint(0, 3) + str(i), rng.choice([0, 1, 7, 2**62, 2**63 - 1, rng.randint(0, 5000)])) for g in "abc" for i in range(400)]
    rows += [("few", "x", 0), ("ties", "k" * 5000, 9), ("ties", "k" * 5000 + "a", 9), ("ties", "k" * 4999, 9)]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k, direct in ((1, 0), (2, 0), (37, 0), (37, 50), (1000, 10)):
        found = {tuple(r) for r in divergence.largest(df, ["g"], k, direct=direct).collect()}
        wanted = {r for g in {r[0] for r in rows} for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]}
        assert found == wanted


# 12 --------------------------------------------------------------------------


def _plain_clusters(rows, k, rounds, dims):
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in starts]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        now = nearest()
        for j in range(len(centroids)):
            members = [v for (_, v), (_, own) in zip(kept, now, strict=True) if own == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    now = nearest()
    inertia = Counter()
    for d, j in now:
        inertia[j] += d
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashes[j]) for (i, _), (d, j) in zip(kept, now, strict=True))


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string, s0 string"


@pytest.mark.parametrize("spread", [0.01, 1.0, 60_000.0])
def test_clusters_against_a_plain_version(spark, spread):
    rng = random.Random(7)
    rows = [(i, [spread * float(rng.randint(-8, 8)) / 8 + rng.choice([0, 0, spread]) for _ in range(4)]) for i in range(300)]
    rows += [(5, rows[5][1])] * 40 + [(900 + i, [0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # repeated rows, one common vector
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [float("nan")] * 4), (2005, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    import numpy as np

    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).repartition(5)
    for k, rounds in ((8, 10), (3, 2), (30, 4)):
        found = ball_kmeans.cluster(df, k=k, rounds=rounds, dims=4, batch_rows=50)
        assert Counter(tuple(r) for r in found.collect()) == _plain_clusters(rows, k, rounds, 4)


def test_clusters_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["distance"]) for r in ball_kmeans.cluster(df, dims=2).collect()) == [(1, 0), (2, 0)]
    assert ball_kmeans.cluster(df.limit(0), dims=2).collect() == []
    assert ball_kmeans.cluster(df, dims=3).collect() == []
    with pytest.raises(Exception, match="after scaling"):
        ball_kmeans.cluster(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"), dims=2).collect()


def test_members_far_from_a_border_are_compared_with_nothing():
    import numpy as np

    seen = []
    inside = ball_kmeans._distances
    balls = ball_kmeans.Balls.first([[0, 0], [1000, 0], [5000, 0]]).after([[0, 0], [1001, 0], [5000, 0]], {0: 501 * 501, 1: 400 * 400, 2: 9})
    assert [[j for j, _ in near] for near in balls.neighbours] == [[1], [], []]
    x = np.array([[1.0, 0], [501.0, 0], [990.0, 0], [5003.0, 0]])
    try:
        ball_kmeans._distances = lambda a, c: seen.append((len(a), tuple(c))) or inside(a, c)
        new, best = ball_kmeans._moved_members(x, np.array([0, 0, 1, 2]), np.array([1, 251001, 100, 9]), balls)
    finally:
        ball_kmeans._distances = inside
    assert new.tolist() == [0, 1, 1, 2] and best.tolist() == [1, 250000, 121, 9]
    assert seen == [(1, (1001.0, 0.0)), (1, (1001.0, 0.0))]  # the annulus of the first ball, the members of the one that moved


# 13 --------------------------------------------------------------------------


def _plain_words(text):
    return [w for w in "".join((c.lower() if c.isascii() else c) if c.isalnum() or ord(c) > 127 else " " for c in text or "").split(" ") if w]


def _plain_matches(docs, items, window):
    runs = defaultdict(set)
    for item, text in items:
        words = _plain_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            runs[tuple(words[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = _plain_words(text), set(), set()
        for n in {len(r) for r in runs}:
            for i in range(len(words) - n + 1):
                if (run := tuple(words[i : i + n])) in runs:
                    hit.update(range(i, i + n))
                    found |= runs[run]
        out.append((doc, len(words), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return Counter(out)


def _leaks():
    rng = random.Random(3)
    words = ["ant", "bee", "cat", "dog", "été", "9"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for i in range(40)]
    items += [(3, items[7][1]), (100, items[7][1]), (None, "ant  BEE, cat!"), (101, None), (102, "..."), (103, "solo"), (103, "solo")]
    items += [(104, " ".join(rng.choices(words, k=70)))]
    docs = [(i, " ".join(rng.choices([*words, "stop"], k=rng.randint(0, 60)))) for i in range(80)]
    docs += [(80, None), (81, ""), (None, items[7][1]), (82, f"Before. {items[104 - 104 + 2][1].upper()}; after"), (83, "x " * 30_000 + items[-1][1]), (84, "Solo"), (84, "Solo"), (85, items[-1][1] + " " + items[-1][1])]
    return docs, items


@pytest.mark.parametrize(("window", "block_words"), [(10, 200_000), (4, 60), (1, 20), (10, 25)])
def test_decontamination_against_a_plain_version(spark, window, block_words):
    docs, items = _leaks()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, words string, longest long").repartition(3)
    found = decontamination.audit(df, spark.createDataFrame(items, "item_id long, text string"), window=window, block_words=block_words)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"]), r["contaminated"]) for r in found.collect())
    assert got == _plain_matches(docs, items, window)


def test_longest_run_and_spans(spark):
    docs = spark.createDataFrame([(1, "zero One two three four x two three four five"), (2, "three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.audit(docs, items, window=3).collect()}
    assert (found[1]["longest"], [tuple(s) for s in found[1]["spans"]], found[1]["n_hit"]) == (4, [(1, 5), (6, 10)], 8)
    assert (found[2]["longest"], found[2]["contaminated"]) == (1, False)


def test_cleaning_cuts_spans_and_drops_copies(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    rows = [
        (1, f"Ünder {'word ' * 40}. {item.upper()}! The end.", "a"),
        (2, f"{item}, yes", "b"),  # mostly the item
        (3, "clean as it is", "c"),
        (4, None, "d"),
        (5, f"{'word ' * 40} Short Item {'word ' * 9}", "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    items = spark.createDataFrame([(1, item), (2, "short item")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.clean(docs, items).collect()}
    assert sorted(found) == [1, 3, 4, 5] and found[1].asDict().keys() == {"doc_id", "text", "spans"}
    assert found[1]["text"] == f"Ünder {'word ' * 40}. ! The end." and found[1]["spans"] == "a"
    assert found[3]["text"] == "clean as it is" and found[4]["text"] is None
    assert found[5]["text"] == f"{'word ' * 40}  {'word ' * 9}"
    assert item.upper() in {r["doc_id"]: r for r in decontamination.clean(docs, items, least_span=13).collect()}[1]["text"]


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "...")], "item_id long, text string")
    for none in (items, items.limit(0)):
        assert [tuple(r) for r in decontamination.audit(docs, none).select("doc_id", "n_words", "n_hit", "n_items", "contaminated", "longest").collect()] == [(1, 2, 0, 0, False, 0)]
        assert decontamination.clean(docs, none).collect() == docs.collect()
    assert decontamination.audit(docs.limit(0), items).collect() == []


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_centroid_clusters", "op13_benchmark_decontamination"])
def test_sql_on_the_larger_tables(spark, name):
    larger = "/root/testdata/sf0.01"
    same_rows(queries.QUERIES[name](spark, larger), duck(larger), queries.ORACLE_SQL[name])
