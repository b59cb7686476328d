"""Every operator gives a defined result for odd rows and for an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import exact_dedup, language_id, licenses, mixing, near_dedup, packing, quality_classifier, quality_rules, token_count, url_filter
from eventloom.llm.queries import tokenizer_path


def _labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("long").alias("quality"), F.lit(None).cast("long").alias("toxic"))


def _exact(docs, call):
    index = exact_dedup.new_index(docs.sparkSession)
    try:
        return call(docs, index)
    finally:
        index.drop()


PER_DOCUMENT = {
    "token_count": lambda d: token_count.count_tokens(d, tokenizer_path("piece_bpe_32k.model")),
    "near_dedup": near_dedup.classes,
    "language_id": lambda d: language_id.identify(d, language_id.train(d)),
    "quality_rules": quality_rules.judge,
    "mixing": mixing.plan,
    "licenses": licenses.scan,
    "exact_dedup": lambda d: _exact(d, exact_dedup.resolve),
    "quality_classifier": lambda d: quality_classifier.score(d, quality_classifier.train(d, _labels(d))),
}


@pytest.mark.parametrize("name", sorted(PER_DOCUMENT))
def test_one_row_per_document(name, edge_docs, no_docs):
    assert len(PER_DOCUMENT[name](edge_docs).collect()) == edge_docs.count()
    assert PER_DOCUMENT[name](no_docs).collect() == []


def test_filters_keep_their_columns(edge_docs, no_docs):
    for own in (lambda d: quality_rules.clean(d), mixing.mix, near_dedup.deduplicate, lambda d: _exact(d, exact_dedup.deduplicate), lambda d: language_id.keep_languages(d, language_id.train(d))):
        assert own(edge_docs).columns == edge_docs.columns
        assert own(edge_docs).count() <= 2 * edge_docs.count()
        assert own(no_docs).count() == 0


def test_exact_groups(edge_docs):
    found = [r.asDict() for r in _exact(edge_docs, exact_dedup.resolve).collect()]
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[4]["group_size"] == 3 and by_id[4]["kept"] and by_id[5]["keep_id"] == 4 and not by_id[5]["kept"]
    assert by_id[2]["keep_id"] == by_id[1]["keep_id"] == 1 and by_id[3]["keep_id"] == 3
    kept = _exact(edge_docs, exact_dedup.deduplicate)
    assert kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id = 5").count() == 0
    assert kept.filter("doc_id IS NULL").count() == 1


def test_url_filter_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (None, "http://A.example.COM/de/x"), (5, "http://h.org/" + "a/" * 20_000), (6, "x://?q")]
    found = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(found) == len(rows)
    assert found[None]["rule"] == "example.com/de/" and found[None]["host"] == "a.example.com"
    assert all(found[i]["verdict"] == "allow" and found[i]["rule"] is None for i in (1, 2, 3, 4, 6))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_packing_edges(edge_docs, no_docs):
    path = tokenizer_path("byte_bpe_50k.json")
    assert packing.pack(no_docs, path).collect() == []
    found = packing.pack(edge_docs, path).collect()
    assert len({r["doc_id"] for r in found}) == len({r["doc_id"] for r in edge_docs.select("doc_id").collect()})
    assert [r["length"] for r in found if r["doc_id"] == 2] == [1]


def test_pipeline_stages_on_empty_tables(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, "").count() == 0


def test_packing_reads_plain_lines_once_and_odd_space_as_the_tokenizer():
    import struct

    from tokenizers import Tokenizer

    class Counted(str):
        bare = 0

        def split(self, *by):
            Counted.bare += not by
            return str.split(self, *by)

    assert packing.chunks(Counted("single spaces, and no other")) == ["single", "spaces,", "and", "no", "other"] and Counted.bare == 0
    path = tokenizer_path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), packing.tokenizer(path)
    whole.encode_special_tokens = True
    for text in ("a b", " a  b ", "a\u00a0b c", "a\x1cb c", "a\u200bb c", "a\nb\n\nc\n", "\na \n b\n c", "a\r\nb", "a\u2003\nb", "Füße, café naïve! e\u0301 x", "a\t b", "", " ", "\n"):
        ids = whole.encode(text, add_special_tokens=False).ids
        assert own.of(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)
