"""What a task and its worker hold is bounded by bytes, whatever the length of texts and the number of words."""

import pyarrow as pa


def _largest_batch(docs) -> int:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["size"])

    return max(r.size for r in docs.mapInArrow(run, "size long").collect())


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    import public_tokenizers as P
    from sightline.llm import bpe, language_ppm, line_dedup, ngram_jaccard

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(40).selectExpr("id as doc_id", "repeat(concat('word ', id, ' '), 50000) as text").coalesce(1)
    model = language_ppm.build_model({"en": [b"the cat sat"]})
    before = spark.conf.get(key, None)
    for operator in (
        lambda: language_ppm.predict(docs, model), lambda: line_dedup.postings_of(docs), lambda: ngram_jaccard.signatures(docs, 5, 4, 5),
        lambda: bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    ):
        spark.conf.unset(key)
        try:
            operator()
            assert _largest_batch(docs) < 6_000_000  # all texts: 15 MB and more
            spark.conf.set(key, "1000000")
            operator()
            assert _largest_batch(docs) < 2_000_000  # the session's own bound stays
        finally:
            spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_word_memo_is_bounded_and_right():
    import xxhash
    from sightline.llm.parity_sketch import _HASH, shingle_set

    words = [b"w%d" % i for i in range(150_000)] + [b"x" * n for n in (20, 2_000_000)]
    assert [_HASH[w] for w in words] == [xxhash.xxh3_64_intdigest(w) for w in words]
    assert len(_HASH) <= 60_000 and max(map(len, _HASH)) < 1000
    first = shingle_set(words[:1000], 3).tolist()
    _HASH.clear()
    assert shingle_set(words[:1000], 3).tolist() == first


def test_fits_start_no_workers_of_their_own(spark):
    """Their small tables are local ones; an RDD of Python rows takes a second set of workers."""
    from sightline.llm.common import _thinned
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(pa.table({"_id": [1, 2, 3], "_group": ["en", "de", "en"]}))
    for df, n in ((docs, 3), (docs.where(F.col("_id") > 9), 0)):
        some = _thinned(df, "_group", 100)
        assert some.columns == ["_group", "_id"] and some.count() == n
        assert "ExistingRDD" not in some._jdf.queryExecution().toString()
