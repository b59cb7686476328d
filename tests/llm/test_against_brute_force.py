"""Operators beyond SQL against plain versions, exact round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import exact_dedup, language_id, licenses, mixing, near_dedup, packing, quality_classifier, quality_rules, queries, token_count, url_filter
from tests.conftest import SF, duck, same_rows

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), duck(), queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def docs():
    return [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()]


# 1 ---------------------------------------------------------------------------


def _unigram(scores):
    from tokenizers.models import Unigram

    low = min(scores.values())
    vocab = [("<unk>", 0.0), *scores.items(), *[(f"<0x{b:02X}>", low) for b in range(256)]]
    return Unigram(vocab, 0, True)


def test_token_counts_match_the_tokenizer(docs):
    scores = token_count.piece_scores(queries.tokenizer_path("piece_bpe_32k.model"))
    own, model = token_count.UnigramCounter(scores), _unigram(scores)
    for _, text in docs[:60]:
        for text in (text, text[:500] + " 東京\U0001f600  ..x"):
            marked = token_count.MARK + text.replace(" ", token_count.MARK)
            assert own.count(text) == len(model.tokenize(marked))


def test_token_count_ties():
    rng = random.Random(1)
    for _ in range(200):
        scores = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -float(rng.randint(1, 3)) for _ in range(8)}
        word = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        assert token_count.UnigramCounter(scores).best(word)[1] == len(_unigram(scores).tokenize(word))


# 2 ---------------------------------------------------------------------------


def _classes(rows, similarity=0.8):
    def shingles(text):
        words = re.findall(r"\w+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    text = dict(rows)
    for a, b in combinations(sorted(root), 2):
        both = len(sets[a] & sets[b])
        if text[a] == text[b] or (both and both >= similarity * (len(sets[a]) + len(sets[b]) - both)):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in root}


def test_near_classes(spark, docs):
    found = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op2_minhash_near_dedup"](spark, SF).collect()}
    assert found == _classes(docs)


def test_near_classes_in_large_buckets(spark):
    """Near copies in chains, and texts that share a long passage but not enough: hubs and their rests."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = fresh(120), []
    for group in range(6):
        text = passage + fresh(60)
        for _ in range(12):
            text = list(text)
            at = rng.randrange(len(text))
            text[at : at + 2] = fresh(2)
            rows.append((len(rows), " ".join(text)))
        rows += [(len(rows) + i, " ".join(passage + fresh(55 + group))) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (2, 16):
        settings = near_dedup.Settings(small_bucket=small, small_rest=4, side=3, hub_rounds=small)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame, settings).collect()} == _classes(rows)


def _most_sent(spark, after: int | None = None) -> int:
    """The last stage's number; given it, the bytes that the tasks of one later stage sent to the driver at most."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = [(s.stageId(), s.resultSize()) for s in (stages.apply(i) for i in range(stages.size()))]
    return max([n for n, _ in found], default=-1) if after is None else max(size for n, size in found if n > after)


def test_near_classes_send_little_to_the_driver(spark):
    """The driver got 100 keys a partition to sort the nodes by, and the table of all classes to send it on."""
    frame = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.md5((F.col("id") * 7 + k).cast("string")) for k in range(5)]).alias("text"))
    names = "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before, after = spark.conf.get(names[0]), _most_sent(spark)
    spark.conf.set(names[0], "40")
    try:
        own = [spark.conf.get(n) for n in names]
        found = near_dedup.classes(frame)
        assert found.filter("kept AND class_size = 1").count() == 5_000
        assert own == [spark.conf.get(n) for n in names]
    finally:
        spark.conf.set(names[0], before)
    assert _most_sent(spark, after) < 150_000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_deduplicate_sends_no_rows_through_the_driver(spark):
    """The pipeline's stage got the keys of all rows that stay there, to send them to every task."""
    frame = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one text of several words "), F.floor(F.col("id") / 2).cast("string")).alias("text"))
    found = near_dedup.deduplicate(frame)
    assert sorted(r["doc_id"] for r in found.collect()) == [*range(0, 300, 2)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_near_classes_of_texts_smaller_than_others(spark):
    """Truncations of one long text, in buckets of any size: whoever is the hub, no link is lost."""
    rng = random.Random(4)
    rows = []
    for _ in range(3):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        lengths = [200, *range(199, 189, -1), *range(152, 142, -1), *range(116, 108, -1), *range(80, 74, -1)]
        rows += [(len(rows) + i, " ".join(text[:n])) for i, n in enumerate(lengths)]
    wanted = _classes(rows)
    assert len(set(wanted.values())) > 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for rest, rounds in ((2, 1), (2, 2), (2, 5), (1000, 4)):
        settings = near_dedup.Settings(bands=1, rows=1, small_bucket=2, small_rest=rest, side=4, hub_rounds=rounds)
        # One band alone, in which all truncations meet: other bands cannot make up for a hub.
        signed = near_dedup.sign(frame, settings).withColumn("bands", F.array(F.floor(F.col("doc_id") / 35)))
        nodes = near_dedup.nodes_of(signed)
        component = {r["node"]: r["component"] for r in near_dedup.link(frame, nodes, settings).collect()}
        found = {r["source"]["doc_id"]: component.get(r["node"], r["node"]) for r in nodes.collect()}
        first = {c: min(i for i, other in found.items() if other == c) for c in found.values()}
        assert {i: first[c] for i, c in found.items()} == wanted


def test_one_shingle_set_for_repeated_rows(spark):
    """Rows that repeat id and text, null ids too, in many tasks: one set a node."""
    rows = [(i, t) for i, t in ((1, "a b c d e f g"), (None, "h i j k l m n"), (2, "o p q r s t u")) for _ in range(40)] + [(3, "v w x y z a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    nodes = near_dedup.nodes_of(near_dedup.sign(frame, near_dedup.Settings())).select("node", "source", (F.col("n") > 1).alias("repeated"))
    sets = near_dedup.shingle_sets(frame, F.broadcast(near_dedup.keep(nodes, "nodes")), near_dedup.Settings()).collect()
    assert len(sets) == len({r["node"] for r in sets}) == 4 and all(len(r["shingles"]) == 3 for r in sets)


def test_weighted_signatures_estimate_similarity():
    element = np.array([near_dedup.mixed(np.array([i], np.uint64))[0] for i in range(300)])
    weight = np.random.default_rng(0).integers(1, 5, (2, 300)).astype(float)
    true = np.minimum(*weight).sum() / np.maximum(*weight).sum()
    names = near_dedup.DartMinHash(1024).signatures(np.repeat([0, 1], 300), np.tile(element, 2), weight.ravel(), 2)
    assert abs((names[0] == names[1]).mean() - true) < 0.06


# 3 ---------------------------------------------------------------------------


def _ppm_bits(train, order, context, byte):
    counts = defaultdict(Counter)
    padded = b"\n" * order + train
    for at in range(order, len(padded)):
        for o in range(order + 1):
            counts[padded[at - o : at]][padded[at]] += 1
    out, gone = 0.0, set()
    for o in range(order, -1, -1):
        own = {b: n for b, n in counts.get(context[order - o :], {}).items() if b not in gone}
        if not own:
            continue
        total = sum(own.values()) + len(own)
        if byte in own:
            return out - math.log2(own[byte] / total)
        out -= math.log2(len(own) / total)
        gone |= set(own)
    return out + math.log2(256 - len(gone))


def test_ppm_costs():
    train, order, rng = b"abracadabra abra cadabra", 2, random.Random(0)
    grams, n = np.unique(language_id.grams(b"\n" * order + train, order), return_counts=True)
    model = language_id.Ppm(grams, n.astype(float), order)
    for _ in range(300):
        data = bytes(rng.choices(b"abrcdz \n", k=order + 1))
        assert model.bits(language_id.grams(data, order))[0] == pytest.approx(_ppm_bits(train, order, data[:order], data[order]))


def test_letters(spark):
    """Number characters are no letters; letters of any script are."""
    texts = {1: "\u00bd \u00b2 12 \u2167 !", 2: "\u6771", 3: "\u00aa", 4: "_ 7", 5: None, 6: "x\u00bd"}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert {i for i, (lang, score) in found.items() if lang == "und" and score == 0} == {1, 4, 5}


def test_sample_of_rows_without_id(spark):
    """Rows with a null id, and repeated rows, keep the sample's bound."""
    docs = spark.createDataFrame([(None, f"text number {i}", "en") for i in range(2000)] + [(7, "the same", "en")] * 2000, "doc_id long, text string, lang string")
    seen = []
    counts = language_id.training_counts
    try:
        language_id.training_counts = lambda rows, order: seen.append(rows.count()) or counts(rows, order)
        language_id.train(docs, sample_docs=100)
    finally:
        language_id.training_counts = counts
    assert 0 < seen[0] < 200


def test_languages_of_held_out_documents(spark):
    found = queries.QUERIES["op3_language_id"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.9


# 4 ---------------------------------------------------------------------------


def test_quality_measures(spark, docs):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i, len(words) - 3) + 1)) for i in range(len(words)))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed

    for r in queries.QUERIES["op4_quality_rules"](spark, SF).collect():
        assert tuple(r)[1:7] == plain(dict(docs)[r["doc_id"]])
    for boilerplate in ("Wir verwenden Cookies auf dieser Seite.", "Tous droits réservés, 2024.", "Política de privacidad", "Privacy Policy"):
        assert quality_rules.clean_text(f"Good text.\n{boilerplate}\nMore.") == "Good text.\nMore."
    prose = "This is a sentence with some words in it number {}.\n"
    junk = "home | news | sport | about | login\n" * 20 + "accept cookies\n" * 20
    text = "".join(prose.format(i) * 1 for i in range(30))
    assert not quality_rules.judge_text(junk + text)[6]
    assert quality_rules.clean_text("home | news | sport | about\nGood text.\n") == "Good text.\n"


def test_quality_verdicts_against_plain_rules(spark, docs):
    """``kept`` of whole texts, each line judged by every rule in turn."""

    def failing(line, words):
        marks = sum(line.count(x) for x in quality_rules.SEPARATORS)
        if marks >= 3 and marks / len(words) >= 0.2:
            return True
        if any(x in line.lower() for x in quality_rules.BOILERPLATE):
            return True
        if len(words) >= 3 and sum(any(w.endswith(x) for x in quality_rules.SYMBOL_ENDS) for w in words) / len(words) > 0.5:
            return True
        return len(words) >= 8 and line.upper() == line != line.lower() and not any(words[-1].endswith(x) for x in quality_rules.SENTENCE_ENDS)

    def plain(text):
        lines = [(x, w) for x in (text or "").split("\n") if (w := re.findall(r"[^\x20\x09-\x0D]+", x))]
        return sum(len(w) for x, w in lines if failing(x, w))

    good = "".join(" ".join(f"word{i}x{j}" for j in range(8)) + ".\n" for i in range(12))  # no window of three words twice
    junk = ["a | b | c | d\n", "Alle Rechte vorbehalten\n", "buy now!! today!! cheap!!\n", "THIS LINE HAS EIGHT WORDS AND NO END\n", "THIS LINE HAS EIGHT WORDS AND AN END.\n", "wow!! calm words\n"]
    made = [good + junk[i % 6] * (i // 6 + 1) for i in range(60)] + [None, "", "\n \n", good * 2]
    texts = dict(docs) | {-1 - i: t for i, t in enumerate(made)}
    found = quality_rules.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        lost = plain(texts[r["doc_id"]])
        assert r["lost_words"] == lost
        assert r["kept"] == (not r["base_failed"] and lost <= 0.3 * r["n_words"])
    assert {r["kept"] for r in found if r["doc_id"] < 0 and not r["base_failed"]} == {True, False}


# 5 ---------------------------------------------------------------------------


def test_automaton_matches_regex():
    rng = random.Random(5)
    globs = ["*.ads.**", "**/x/**", "**.exe", "*a*b", "**", "a*"] + ["".join(rng.choices(["a", "b", "/", ".", "*", "**"], k=rng.randint(1, 9))) for _ in range(60)]
    globs = [g for g in globs if "***" not in g]
    texts = ["", *("".join(rng.choices("ab/.xés", k=rng.randint(1, 14))) for _ in range(300))]
    # Rules longer than a word of bits, with a text each that they fit but for the last character.
    long = ["".join(rng.choices("ab", k=200)), "**" + "".join(rng.choices("ab/", k=150)) + "**x", "a" * 63 + "*b"]
    globs += long
    texts += [long[0], long[0][:-1] + "c", "éé" + long[1][2:-3] + "//x", long[1][2:-3] + "//y", "a" * 63 + "éb", "a" * 62 + "éb"]
    found = url_filter.Automaton.of(globs).matches(texts, most_chars=500)
    assert found[-6:, -3:].sum() == 3
    for (i, text), (j, glob) in product(enumerate(texts), enumerate(globs)):
        assert found[i, j] == bool(re.search(queries._glob_regex(glob), text)), (text, glob)


# 6 ---------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    once, twice = ({r["doc_id"]: r for r in queries.QUERIES["op6_mix_sources"](spark, LARGER).collect()} for _ in range(2))
    assert once == twice
    assert all(r["taken"] <= 2 * r["size"] for r in once.values())
    # Independent draws: within four standard deviations of the sum of words, and close overall.
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{LARGER}/documents.parquet'").fetchall())
    taken, target, variance = defaultdict(float), {}, defaultdict(float)
    for r in once.values():
        key = source[r["doc_id"]]
        fraction = (r["target"] / r["source_size"]) % 1
        taken[key] += r["taken"]
        target[key] = r["target"]
        variance[key] += r["size"] ** 2 * fraction * (1 - fraction)
    assert all(abs(taken[k] - target[k]) <= 4 * variance[k] ** 0.5 + 1 for k in target)
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.03


def test_mix_emits_what_is_planned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect() if r["copies"]}
    assert planned == dict(Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect()))


# 7 ---------------------------------------------------------------------------


def test_license_places(spark):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in queries.QUERIES["op7_license_scan"](spark, LARGER).filter("doc_id < 400 OR n_base > 0").collect():
        text = duckdb.execute(f"SELECT text FROM '{LARGER}/documents.parquet' WHERE doc_id = ?", [r["doc_id"]]).fetchall()[0][0]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(upper))
        places = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_in_every_row(spark):
    """A notice that all documents hold has its label and score as in any other table."""
    for n in (1, 3):
        rows = licenses.scan(spark.createDataFrame([(i, "Released under the MIT License.") for i in range(n)], "doc_id long, text string")).collect()
        assert [(r["base_labels"], r["labels"], r["score"]) for r in rows] == [("mit", "mit,mit-notice", 1.0)] * n


def _many_templates(docs):
    """Three hundred notices cut from texts, beside the usual ones."""
    rng, made = random.Random(9), []
    pool = [w for w in (re.findall(r"[0-9a-z]+", t.lower()) for _, t in docs) if len(w) > 30]
    while len(made) < 300:
        words = rng.choice(pool)
        at, n = rng.randrange(len(words) - 20), rng.randint(4, 14)
        own = words[at : at + n]
        cut = rng.randrange(n - 2)
        made.append(licenses.Template(f"own-{len(made)}", " ".join(own), " ".join(own[cut : cut + rng.randint(2, 5)])))
    return [*licenses.NOTICES, *made]


def test_the_plan_does_not_grow_with_the_templates(spark, docs):
    def operations(notices):
        texts = spark.createDataFrame(docs[:3], "doc_id long, text string")
        plan = licenses.scan(texts, notices=notices)._jdf.queryExecution().optimizedPlan().toString()
        return len(plan.splitlines()), plan.count("lambdafunction")

    assert operations(licenses.NOTICES) == operations(_many_templates(docs))


@pytest.mark.parametrize("many", [False, True])
def test_license_labels_and_scores_against_plain_search(spark, docs, many):
    """Every template at every place, with IDF over the same rows."""
    notices = _many_templates(docs) if many else licenses.NOTICES
    made = [
        "This work is licensed under the GNU General Public License version 3.",
        "gnu general public license, version 2; released under the MIT license",
        "apache license version 2 0",
        "version 2 0 apache license apache license version 2 0 licensed under the",
        "Redistribution and use in source and binary forms are not allowed",
        "permission is hereby granted, free of charge",
        "licensed under CC BY 4.0 and licensed under CC BY NC 4.0",
        "gnu general public licence", "", None,
    ]
    texts = dict(docs) | {-1 - i: t for i, t in enumerate(made)}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper)) for i, t in texts.items()}
    having = Counter(w for own in words.values() for w in set(own))
    weight = lambda w: math.log((1 + len(texts)) / (1 + having[w])) + 1
    found = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), notices=notices).collect()
    assert len(found) == len(texts)
    for r in found:
        own, labels, best = words[r["doc_id"]], set(), 0.0
        for t in [*licenses.BASE, *notices]:
            key, whole = t.key.split(), sum(map(weight, t.words))
            starts = [i - t.key_at for i in range(len(own)) if own[i : i + len(key)] == key]
            share = max((sum(weight(w) for j, w in enumerate(t.words) if 0 <= s + j < len(own) and own[s + j] == w) / whole for s in starts), default=0.0)
            best = max(best, share)
            if starts and (t.base or share >= 0.5):
                labels.add(t.label)
        assert r["labels"] == ",".join(sorted(labels))
        assert r["score"] == pytest.approx(min(1.0, best))
    assert len({x for r in found for x in r["labels"].split(",")}) > 8


# 8 ---------------------------------------------------------------------------


def _same_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
            assert k == 0 or r["length"] == capacity
        assert at == len(ids)
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_round_trip(spark, docs):
    rows = queries.QUERIES["op8_best_fit_packing"](spark, SF).collect()
    used = _same_packing(rows, dict(docs))
    assert used <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 2048)


def test_packing_odd_spaces(spark):
    texts = {i: t for i, t in enumerate([None, "", " ", "a  b", "x\n\ny", "don't stop. Now!\tyes  \n z", "  lead", "tail  ", "a\u00a0b c", "...,!? x,y", "1 2 33 444", "<|endoftext|> a", "it's, well:so;ok", "A\r\nB \n C"])}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), queries.tokenizer_path("byte_bpe_50k.json")).collect()
    _same_packing(rows, texts)


def test_ranks_in_small_blocks(spark):
    frame = spark.createDataFrame([(i, f"w{i % 3}") for i in range(500)], "doc_id long, text string")
    rows = packing.pack(frame, queries.tokenizer_path("byte_bpe_50k.json"), capacity=16, block_rows=7).collect()
    _same_packing(rows, {i: f"w{i % 3}" for i in range(500)}, 16)


def test_equal_rows_are_dealt_to_many_blocks(spark):
    """A row repeated thousands of times fills no block beyond its share."""
    cut = corpus_pipeline.keep(spark.range(0, 4000, 1, 4).selectExpr("CAST(1 AS BIGINT) AS doc_id", "0 AS piece", "CAST(0 AS BIGINT) AS start", "CAST(3 AS BIGINT) AS length", "CAST(7 AS BIGINT) AS ids_crc32"), "equal-pieces")
    lengths = spark.createDataFrame([(3, 4000)], "length long, n long")
    ranks = packing.ranked(cut, lengths, 100)
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(4000))
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    dealt = cut.select(F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(40)).alias("b")).groupBy("b").count().collect()
    assert "row_index" in plan and len(dealt) == 40 and max(r["count"] for r in dealt) < 200


# 9 ---------------------------------------------------------------------------


def test_index_persists_between_batches(spark):
    index = exact_dedup.new_index(spark)
    try:
        batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
        first = exact_dedup.resolve(batch((1, "a b"), (2, "a  b"), (3, "c")), index).collect()
        assert {r["doc_id"]: r["kept"] for r in first} == {1: True, 2: False, 3: True}
        assert index.rows().count() == 2
        second = {r["doc_id"]: r for r in exact_dedup.resolve(batch((0, "a\tb"), (4, "d")), index).collect()}
        assert second[0]["keep_id"] == 1 and not second[0]["kept"] and second[4]["kept"]
        assert index.rows().count() == 3
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = batch((1, "x")).selectExpr("CAST(text AS BINARY) AS digest").join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        # Only the new side is shuffled: the index lies in buckets by digest.
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        index.drop()


def test_a_batch_fed_twice_is_answered_as_before(spark, tmp_path):
    """Also by another index object that knows only the path, and after a failure before the manifest was written."""
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string, digest string")
    first, second = frame((1, "a b", "x"), (2, "a  b", "x"), (3, "c", "x"), (3, "c", "x"), (None, "c", "x")), frame((0, "c", "x"), (5, "new", "x"))
    answers = lambda docs, index: sorted((tuple(r) for r in exact_dedup.resolve(docs, index).collect()), key=repr)
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    told = answers(first, index), answers(second, index)
    assert (answers(first, index), answers(second, index)) == told
    assert [r["doc_id"] for r in exact_dedup.deduplicate(second, index).collect()] == [5]
    assert exact_dedup.deduplicate(first, index).filter("doc_id = 3").count() == 1
    # As another session finds it: the files only.
    spark.sql(f"DROP TABLE {index._table(4)}")
    again = exact_dedup.DigestIndex(spark, path)
    assert (answers(first, again), answers(second, again)) == told and len(again.batches()) == 2 and again.rows().count() == 3
    exact_dedup.deduplicate(frame((9, "third", "x")), again)
    assert again.rows().count() == 4
    # An append whose batch never reached the manifest has no effect.
    lost = exact_dedup.DigestIndex(spark, str(tmp_path / "lost"), 4)
    answers(first, lost)
    exact_dedup.delete(spark, f"{lost.path}/manifest")
    assert lost.rows().count() == 0 and answers(first, lost) == told[0] and lost.rows().count() == 2
    # A name given by the caller.
    assert [r["kept"] for r in exact_dedup.resolve(frame((7, "named", "x")), again, "monday").collect()] == [True] and "monday" in again.batches()
    for own in (again, lost):
        own.drop()
        assert not exact_dedup.exists(spark, own.path)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_whole_table_through_the_index(spark, edge_docs, batches):
    """In any number of batches the smallest id stays, null ids come last, and the index holds every digest once."""
    rows = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in edge_docs.collect()]
    rows_in_order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, text in rows_in_order:
        first.setdefault(text, i)
    index = exact_dedup.new_index(spark)
    try:
        found = exact_dedup.resolve_table(edge_docs, index, batches).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found), key=repr) == sorted(
            ((i, first[t], sum(t == u for _, u in rows), i == first[t]) for i, t in rows), key=repr
        )
        assert index.rows().count() == len(first)
    finally:
        index.drop()


# 10 --------------------------------------------------------------------------


def test_the_sample_keeps_its_bound(spark, monkeypatch):
    """One id thousands of times, with one text or many: neither fills the sample."""
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda docs, labels: seen.append(len(docs)))
    rows = [(1, "again and again")] * 3000 + [(2, f"text {i}") for i in range(3000)] + [(i, f"doc {i}") for i in range(10, 400)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in {r[0] for r in rows}], "doc_id long, quality int")
    quality_classifier.train(docs, labels, sample_docs=60)
    quality_classifier.train(docs, labels, sample_docs=10**6)
    learnable = {r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert seen[0] <= 60 + 5 * 60**0.5 and seen[1] == len(learnable)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    lengths, transition = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    good = rng.normal(size=lengths.sum())
    p, _, log_z = quality_classifier.Chains(lengths).marginals(good, transition)
    at, whole = 0, 0.0
    for n in lengths:
        weights = {y: math.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(transition[y[i], y[i + 1]] for i in range(n - 1))) for y in product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        whole += math.log(z)
        for i in range(n):
            assert p[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / z)
        at += n
    assert log_z == pytest.approx(whole)


def test_quality_of_held_out_documents(spark):
    found = queries.QUERIES["op10_quality_classifier"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.8
    assert found.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


# pipeline --------------------------------------------------------------------


def test_pipeline_leaves_settings_and_folders_as_they_were(spark):
    import os

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    folders = lambda: {d for d in os.listdir(spark.conf.get("spark.checkpoint.dir")) if not d.startswith((".", "_"))}
    before, there = spark.conf.get(name), folders()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(folders() - there) == 1  # the last stage's rows
    assert spark.conf.get(name) == before


def test_pipeline(spark, docs):
    """Each stage on what its predecessor kept, against the plain versions."""
    found = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = found.columns, []
    for _, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.keep(stage(spark, found, SF), "stage")
        kept.append(found)
    assert all(k.columns == columns for k in kept[:-1])
    known, exact, near, mixed, packed = ([tuple(r) for r in k.select("doc_id", *(["text"] if "text" in k.columns else [])).collect()] for k in kept)
    assert len(known) > 0.9 * sum(bool(re.search(r"[^\W\d_]", t)) for _, t in docs)
    assert all(re.search(r"[^\W\d_]", t) for _, t in known)
    first = {}
    for i, t in sorted(known):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(i for i, _ in exact) == sorted(first.values())
    assert {i for i, _ in near} == set(_classes(exact).values())
    planned = Counter({r["doc_id"]: r["copies"] for r in mixing.plan(kept[2]).collect() if r["copies"]})
    assert Counter(i for i, _ in mixed) == planned
    assert {i for (i,) in packed} == set(planned)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept[-1].collect())


@pytest.mark.parametrize("name", ["op6_mix_sources", "op7_license_scan", "op9_exact_dedup"])
def test_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
