"""Operators against brute force, round trips and held-out labels; defined results at the edges."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import pytest

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, k1 string, label string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", None, "y") for i, t in rows], DOC_SCHEMA)


EDGES = [(1, None), (2, ""), (3, "  \n\t"), (None, "a b c d e f g h"), (4, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "word " * 30_000), (7, "x")]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, p, q):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and q * len(x & y) >= p * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark, documents):
    from sightline.llm.ngram_jaccard import document_components, join

    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    base = "one two three four five six seven eight nine ten " * 3 + " ".join(f"w{i}" for i in range(120))
    for n in range(40):  # a chain of near copies, few of which are like the first
        ws = base.split()
        for j in range(n // 2):
            ws[35 + 2 * j] = f"z{j}"
        rows.append((100_000 + n, " ".join(ws)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in document_components(join(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_sketch_keys_lose_no_similar_pair():
    import random

    from sightline.llm.parity_sketch import bands, shingle_set

    random.seed(5)
    for p, q in ((9, 10), (4, 5)):
        how = bands(p, q)
        for _ in range(300):
            n = random.choice([8, 12, 20, 45, 90, 300])
            a = [b"%d" % random.randrange(10**6) for _ in range(n)]
            b = list(a)
            for _ in range(random.randrange(1, max(2, n // 12))):
                b[random.randrange(n)] = b"x%d" % random.randrange(10**6)
            x, y = shingle_set(a, 1), shingle_set(b, 1)
            if how.similar(x, y) and set(x.tolist()) != set(y.tolist()):
                assert set(how.keys(x).tolist()) & set(how.keys(y).tolist())


def test_sketch_distances_never_exceed_the_difference():
    """Sketches of any widths bound the symmetric difference from below, and tell unlike long sets apart."""
    import numpy as np

    from sightline.llm.ngram_jaccard import _distances, _folded, _sketch

    rng = np.random.default_rng(3)
    for n in (1, 5, 900, 1030, 5000, 70_000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.int64).view(np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 1 << 63, n // 5 + 1, np.int64).view(np.uint64)]))
        other = np.unique(rng.integers(0, 1 << 63, n, np.int64).view(np.uint64))
        x, y, z = map(_sketch, (a, b, other))
        differ = len(np.setxor1d(a, b))
        assert _distances([x, y], [y, x]).max() <= differ and _distances([x], [x])[0] == 0
        assert _distances([_folded(x)], [_folded(y)])[0] <= differ
        if 900 <= n:
            assert _distances([x], [z])[0] > 2 * n // 9


def test_members_of_shared_keys(spark):
    """Keys of one class, or of guests (odd keys) alone, give nothing; others give each class once, with the least own one, over any batches."""
    from sightline.llm import ngram_jaccard

    rng = random.Random(5)
    pairs = [(rng.randrange(60) * 2 + (n < 0), n) for n in (rng.randrange(9) - 4 for _ in range(300))] + [(198, n) for n in range(50)] + [(199, -n) for n in range(1, 30)] + [(154, 3)] * 9 + [(161, -n) for n in range(1, 9)]
    packed = [(k // 2 % 3, [k], [n]) for k, n in pairs]
    groups: dict[int, set[tuple[int, int]]] = {}
    for k, n in pairs:
        groups.setdefault(k & ~1, set()).add((k & 1, n))
    want = sorted((k, n, min(g)[1], not guest) for k, g in groups.items() if len(g) > 1 and not min(g)[0] for guest, n in g)
    assert {k for k, *_ in want} >= {198} and not {k for k, *_ in want} & {154, 160}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (1, 2, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = ngram_jaccard._members(spark.createDataFrame(packed, "bucket int, keys array<long>, nodes array<long>")).collect()
            assert sorted(map(tuple, got)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize(("k", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join_over_many_tiles_and_all_links(spark, monkeypatch, k, p, q):
    """Buckets of several tiles, many of one head's pairs, no broadcast of ids: components and links equal brute force."""
    from sightline.llm import ngram_jaccard as J

    monkeypatch.setattr(J, "TILE", 4)
    monkeypatch.setattr(J, "HEAD_PAIRS", 3)
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rng, rows = random.Random(k), []
    for size in (30, 90, 240):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        shared = base[: size // 2]
        for _ in range(25):  # near copies: some alike, some alike in part only
            ws = list(base)
            for _ in range(rng.randrange(0, max(2, size // 20))):
                ws[rng.randrange(size)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws)))
        for _ in range(15):  # a passage of half the text that unlike documents share
            rows.append((len(rows), " ".join(shared + [f"y{rng.randrange(10**6)}" for _ in range(size - size // 2)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, k, p, q)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.document_components(J.join(df, k, p, q)).collect()} == want
    sets = {i: shingles(t, k) for i, t in rows}
    links = {i: sum(1 for j in sets if j != i and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])) for i in sets}
    assert sum(links.values()) > 100
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.link_counts(J.all_links(df, k, p, q)).collect()} == {i: (*want[i], links[i]) for i in want}


def test_jaccard_links_classes_of_null_and_repeated_ids(spark):
    from sightline.llm import ngram_jaccard as J

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (None, text + " x"), (3, "a b c d e f"), (3, text + " y"), (7, "a b c d e f"), (9, text + " x y")]
    got = sorted(((r.doc_id, r.component_id) for r in J.document_components(J.join(spark.createDataFrame(rows, "doc_id long, text string"))).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 3), (3, 1), (7, 3), (9, 1)], key=str)
    one = lambda rows: sorted(((r.doc_id, r.text) for r in J.near_duplicates(odd(spark, rows)).collect()), key=str)
    assert one([(1, text), (1, text), (2, text)]) == [(1, text)]
    assert one(rows) == sorted([(1, text), (3, "a b c d e f")], key=str)
    assert one([(None, text), (None, text + " x"), (None, "")]) == sorted([(None, text), (None, "")], key=str)
    assert one([(5, text), (5, "b c d e f g"), (4, text + " x")]) == [(4, text + " x"), (5, "b c d e f g")]


def test_jaccard_edges(spark):
    from sightline.llm.ngram_jaccard import document_components, join, near_duplicates

    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in document_components(join(odd(spark, EDGES))).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 6, 4), (4, 6, 4), (5, 6, 4), (5, 6, 4), (6, 1, 6), (7, 1, 7)], key=str)
    assert document_components(join(odd(spark, []))).count() == 0
    assert sorted(str(r.doc_id) for r in near_duplicates(odd(spark, EDGES)).collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7]))


def brute_lines(rows, min_docs=3):
    keys = [{k for line in (t or "").split("\n") if len(b := line.strip(" \t\n\x0b\x0c\r")) >= 20 for k in [b.encode().lower()]} for _, t in rows]
    hold = {}
    for (i, _), ks in zip(rows, keys):
        for k in ks:
            hold.setdefault(k, []).append(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(x.strip(" \t\n\x0b\x0c\r")) >= 20 and len(h := hold[x.strip(" \t\n\x0b\x0c\r").encode().lower()]) >= min_docs and i != max(h))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_is_exact_and_reversible(spark, documents):
    from sightline.llm import line_dedup as L

    docs = documents.select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    result = lambda d, ix: {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in L.rewrite(d, ix).collect()}
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = L.build(first)
    before = result(first, index)
    assert before == brute_lines([r for r in rows if r[0] % 2 == 0])
    index = L.insert(index, second)
    assert result(docs, index) == brute_lines(rows)
    index = L.delete(index, second)
    assert result(first, index) == before


def test_line_dedup_edges(spark):
    from sightline.llm import line_dedup as L

    line = "A line that is long enough"
    out = L.dedup_lines(odd(spark, [(1, None), (2, ""), (3, line), (4, "x\n " + line.upper() + "\t"), (5, line + "\n" + line), (None, line)]))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()} == {1: (1, 0, None), 2: (1, 0, ""), 3: (1, 1, ""), 4: (2, 1, "x"), 5: (2, 0, line + "\n" + line), None: (1, 1, "")}
    assert L.dedup_lines(odd(spark, [])).count() == 0


def test_cuckoo_filter():
    import numpy as np

    from sightline.llm.cuckoo import CuckooFilter

    k = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, (3000, 2))
    f = CuckooFilter(1000)  # overfull: the stash takes the rest
    f.insert(k[:2500, 0], k[:2500, 1])
    assert f.contains(k[:2500, 0], k[:2500, 1]).all() and f.contains(k[2500:, 0], k[2500:, 1]).mean() < 0.05
    f.delete(k[:2000, 0], k[:2000, 1])
    g = CuckooFilter.from_bytes(f.to_bytes())
    assert g.contains(k[2000:2500, 0], k[2000:2500, 1]).all() and g.contains(k[:2000, 0], k[:2000, 1]).mean() < 0.1


def test_cuckoo_arrays_and_an_index_that_outgrows_its_filters(spark):
    import time

    import numpy as np

    from sightline.llm import line_dedup as L
    from sightline.llm.cuckoo import CuckooFilter

    k = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, (200_000, 2))
    began, f = time.time(), CuckooFilter(200_000)
    f.insert(k[:, 0], k[:, 1])
    assert f.contains(k[:, 0], k[:, 1]).all() and len(f.stash) < 20 and time.time() - began < 5
    rows = lambda a, b: spark.createDataFrame([(3 * i + j, f"a line of text with the number {i}") for i in range(a, b) for j in range(3)], "doc_id long, text string")
    index = L.insert(L.build(rows(0, 5)), rows(5, 6005))
    held = [CuckooFilter.from_bytes(bytes(r.filter)) for r in index.filters.collect()]
    assert len(held) == 1 and not held[0].stash and held[0].table.size > 6005
    assert L.rewrite(rows(0, 6005), index).where("n_dropped = 1").count() == 2 * 6005


def test_added_columns_replace_those_of_the_same_name(spark):
    from sightline.llm import decontaminate, language_ppm, line_dedup, ngram_jaccard

    line = "A line that is long enough"
    docs = spark.createDataFrame([(i, line, "x", 7, "l", "b", "k") for i in range(4)], "doc_id long, text string, lang_pred string, n_lines long, _lost_keys string, _bad string, _id string")
    model = language_ppm.build_model({"en": [b"the cat sat"]})
    out = language_ppm.predict(docs, model)
    assert out.columns.count("lang_pred") == 1 and {r.lang_pred for r in out.collect()} == {"en"}
    out = line_dedup.dedup_lines(docs)
    assert {(r.doc_id, r.n_lines, r.n_dropped, r._lost_keys) for r in out.collect()} == {(0, 1, 1, "l"), (1, 1, 1, "l"), (2, 1, 1, "l"), (3, 1, 0, "l")}
    bench = spark.createDataFrame([(1, "long enough a line that is")], "item_id long, text string")
    assert decontaminate.clean(docs, bench).columns == docs.columns and decontaminate.clean(docs, bench).count() == 4
    assert [tuple(r) for r in ngram_jaccard.near_duplicates(docs).collect()] == [(0, line, "x", 7, "l", "b", "k")]


def test_empty_tables_give_empty_results(spark):
    from sightline.llm import bpe, html_text, language_ppm, quality_crf, toxicity, warc

    import public_tokenizers as P

    docs, pages = odd(spark, []), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert warc.derivatives(warc.responses_from_pages(pages)).count() == html_text.extract(pages).count() == 0
    for module in (toxicity, quality_crf):
        assert module.score_documents(docs, module.train(docs, labels)).count() == 0
    assert language_ppm.predict(docs, language_ppm.train(docs)).count() == 0
    assert bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_fits_take_whole_texts_within_their_bytes(spark):
    from sightline.llm.common import labelled_sample, stable_sample

    docs = spark.createDataFrame([(i, "w" * (50 * i), "en") for i in range(1, 41)] + [(5, "short", "en"), (None, "x", "en"), (90, None, "en")], "doc_id long, text string, lang string")
    got = stable_sample(docs, "doc_id", "lang", "text", 100, 10_000)
    texts = {r.doc_id: r.text for r in docs.collect()} | {5: "short"}
    assert 5 < len(got) < 41 and sum(len(t) for *_, t in got) <= 10_000 and all(t == texts[i] for i, _, t in got) and len({i for i, *_ in got}) == len(got)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 11)] + [(3, 0), (4, None)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 100, 10**6, fold=(5, 0))
    own = {i for i in texts if i and zlib.crc32(str(i).encode()) % 5}
    want = sorted([(texts[i], i % 2) for i in own if 1 <= i <= 10], key=str)
    assert sorted(rows, key=str) == want


def test_label_model_equals_brute_force_em():
    """Posteriors of labelled and unlabelled rows, by a plain EM over dictionaries; unlabelled rows get theirs from the voters."""
    import numpy as np

    from sightline.llm.toxicity import LABEL_ACCURACY, fit_label_model

    rng = np.random.default_rng(8)
    truth = rng.random(400) < 0.3
    votes = np.stack([np.where(rng.random(400) < p, np.where(rng.random(400) < q, truth, ~truth) * 2 - 1, 0) for p, q in ((0.9, 0.9), (0.6, 0.8), (0.8, 0.7))], 1)
    known = np.where(np.arange(400) < 120, truth, -1).astype(int)
    model = fit_label_model(votes, known, 0.3, rounds=200)
    got = model.posterior(votes, known)

    n, k = votes.shape
    post = [known[i] * 0.94 + 0.03 if known[i] >= 0 else 0.9 if votes[i].sum() > 0 else 0.05 for i in range(n)]
    for _ in range(200):
        rate = {}
        for y in (0, 1):
            for j in range(k):
                total = {v: 0.5 + sum(post[i] if y else 1 - post[i] for i in range(n) if votes[i, j] == v) for v in (-1, 0, 1)}
                rate |= {(y, j, v): total[v] / sum(total.values()) for v in total}
        mean = {(y, j): sum(v * rate[y, j, v] for v in (-1, 0, 1)) for y in (0, 1) for j in range(k)}
        left = [[votes[i, j] - post[i] * mean[1, j] - (1 - post[i]) * mean[0, j] for j in range(k)] for i in range(n)]
        dot = lambda a, b: sum(left[i][a] * left[i][b] for i in range(n)) / n
        corr = [[1.0 if a == b else dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in range(k)] for a in range(k)]
        weight = [1 / max(1, sum(max(0.0, min(1.0, corr[a][j])) ** 2 for a in range(k))) for j in range(k)]
        new = []
        for i in range(n):
            z = math.log(0.3 / 0.7) + sum(weight[j] * math.log(rate[1, j, votes[i, j]] / rate[0, j, votes[i, j]]) for j in range(k))
            z += (2 * known[i] - 1) * math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) if known[i] >= 0 else 0
            new.append(1 / (1 + math.exp(-z)))
        done, post = max(abs(a - b) for a, b in zip(new, post)) < 1e-4, new
        if done:
            break
    assert np.abs(got - np.array(post)).max() < 1e-3
    free = known < 0
    assert ((got > 0.5) == truth)[free].mean() > 0.85 and 0 < (got[free] > 0.5).mean() < 1


def test_warc_reads_gzipped_and_cut_files(spark, tmp_path):
    import gzip

    from sightline.llm import warc

    head = lambda i, n: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {n}\r\n\r\n".encode()
    blocks = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>é {i} {'x' * 3000}".encode() for i in range(500)]
    records = [head(i, len(b)) + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"junk" + b"".join(records)[:-200])
    (tmp_path / "d.warc").write_bytes(b"")
    rows = warc.read_responses(spark, str(tmp_path)).collect()
    assert len(rows) == 1500 and sorted({r.record_id for r in rows}) == sorted(f"<urn:{i}>" for i in range(500))
    assert all(r.payload == blocks[int(r.record_id[5:-1])].partition(b"\r\n\r\n")[2].decode() for r in rows if not r.record_id == "<urn:499>") and {r.content_type for r in rows} == {"text/html"}
    made = warc.derivatives(warc.read_responses(spark, str(tmp_path / "a.warc.gz")))
    assert made.count() == 1000 and made.where("refers_to = '<urn:7>' and warc_type = 'conversion'").first().block.startswith("é 7 xxx")


def test_warc_pages_of_unclosed_tags_take_linear_time(spark):
    import time

    from sightline.llm import warc

    pages = [(i, "u", x) for i, x in enumerate(["<!--" * 100_000, "<p " * 100_000, "<title" * 60_000, "<script" * 60_000, "a<p>b<i c < 3 d", "a<!-- x --> b <!-- c"])]
    began = time.time()
    rows = warc.derivatives(warc.responses_from_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert time.time() - began < 20 and sorted(r.block for r in rows if r.warc_type == "conversion") == ["", "", "", "", "a\nb", "a b"]


def test_warc_records_link_and_round_trip(spark):
    from sightline.llm import warc

    pages = spark.createDataFrame([(1, "http://a/", "<title>T</title><p>Hi &amp; b&#33;<script>x</script><p>two\n  words", 0), (2, None, None, 0)], "page_id long, url string, html string, block int")
    rows = warc.derivatives(warc.responses_from_pages(pages)).collect()
    text = {(r.target_uri, r.warc_type): r for r in rows}
    assert text[("http://a/", "conversion")].block == "T\nHi & b!\ntwo words" and text[(None, "conversion")].block == ""
    assert len(rows) == 4 and all(r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() for r in rows)
    assert text[("http://a/", "metadata")].refers_to == text[("http://a/", "conversion")].refers_to
    for r in warc.serialize(warc.derivatives(warc.responses_from_pages(pages))).collect():
        ((heads, block),) = warc.parse_records(bytes(r.record))
        assert heads["warc-record-id"] == r.record_id and heads["warc-refers-to"].startswith("<urn:uuid:") and len(block) == int(heads["content-length"])


def test_warc_decodes_all_references_and_keeps_source_headers(spark):
    from sightline.llm import warc

    html = "<p>l&#x27;&eacute;t&#xE9; f&uuml;r &rsquo;&#128512;&nbsp;&amp;lt; &amp;#33; &copy;<p>a&nbsp; b"
    made = warc.derivatives(warc.responses_from_pages(spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")))
    assert {r.block for r in made.collect() if r.warc_type == "conversion"} == {"l'été für ’😀 &lt; &#33; ©\na b"}
    for r in warc.serialize(made).collect():
        ((heads, block),) = warc.parse_records(bytes(r.record))
        lines = [x.partition(": ")[2] for x in block.decode().split("\r\n") if x.startswith("source-http-header: ")]
        assert heads["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert lines == (warc.HTTP_HEADERS.split("\r\n")[:-1] if heads["warc-type"] == "metadata" else [])


def test_ppm_tables_equal_walking_the_trees():
    from sightline.llm.language_ppm import build_model, identify

    def context_counts(texts, order):
        trees = [{} for _ in range(order + 1)]
        for raw in texts:
            for k in range(order + 1):
                for i in range(k, len(raw)):
                    seen = trees[k].setdefault(raw[i - k : i], {})
                    seen[raw[i]] = seen.get(raw[i], 0) + 1
        return trees

    samples = {"a": [b"the cat sat on the mat and the hat"], "b": [b"der hund und die katze und der hut", b"das"]}
    model = build_model(samples, 3)

    def walk(tree, raw):
        bits = 0.0
        for i, s in enumerate(raw):
            for k in range(min(3, i), -1, -1):
                seen = tree[k].get(raw[i - k : i])
                if seen and s in seen:
                    bits += math.log2((sum(seen.values()) + len(seen)) / seen[s])
                    break
                if seen:
                    bits += math.log2((sum(seen.values()) + len(seen)) / len(seen))
            else:
                bits += 8
        return bits

    raws = [b"the hut", b"katze sat", "übel zq".encode(), b"d"]
    for raw, bits in zip(raws, model.many(raws)):
        assert bits == pytest.approx([walk(context_counts(samples[x], 3), raw) for x in ("a", "b")], rel=1e-5)
    assert [x[0] for x in identify(model, [None, "", "12 !", "the cat", "und der"])] == ["und", "und", "und", "a", "b"]
    long = "the cat and " * 40_000
    assert identify(model, [long])[0][0] == "a"


def test_language_held_out_accuracy(spark):
    from sightline.llm.queries import op6_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = [r for r in op6_language_id(spark, SMALL).collect() if r.held_out]
    assert got and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) >= 0.9 * len(got)


def test_classifiers_on_held_out_rows(spark):
    from sightline.llm.queries import op4_toxicity, op8_quality_classifier

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, name in ((op4_toxicity, "toxic"), (op8_quality_classifier, "quality")):
        rows = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert sum(labels[r.doc_id][name] == r.predicted for r in rows) >= 0.93 * len(rows)
        assert all(0 <= r.score <= 1 for r in rows)


def test_label_model_weakens_repeated_voters():
    import numpy as np

    from sightline.llm.toxicity import fit_label_model

    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.3
    one = np.where(rng.random(3000) < 0.9, y, ~y) * 2 - 1
    votes = np.stack([one, one, np.where(rng.random(3000) < 0.7, y, ~y) * 2 - 1], 1)
    model = fit_label_model(votes, np.where(np.arange(3000) < 600, y, -1).astype(int), 0.3)
    assert model.weight[0] < 0.75 * model.weight[2] and model.accuracy[0] > model.accuracy[2]


def test_scores_of_empty_texts(spark):
    from sightline.llm import quality_crf, toxicity

    tox = toxicity.fit([("you idiot", 1), ("a fine day", 0)] * 200, prior=0.15)
    good = quality_crf.fit([("A line of text here.", 1), ("BUY!! NOW!! BUY!! NOW!!", 0)] * 20)
    docs = odd(spark, EDGES)
    for rows in (toxicity.score_documents(docs, tox).collect(), quality_crf.score_documents(docs, good).collect()):
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert tox.score(None) < 0.5 < tox.score("what an idiot")


def test_crf_marginals_equal_enumeration():
    import numpy as np

    from sightline.llm.quality_crf import N_FEATURES, LineCRF

    rng = np.random.default_rng(2)
    crf = LineCRF(rng.normal(size=(N_FEATURES, 2)), rng.normal(size=(2, 2)))
    mats = [rng.random((n, N_FEATURES)) for n in (1, 4, 3)]
    for mat, got in zip(mats, crf.marginals(mats)[0]):
        n, total, good = len(mat), 0.0, np.zeros(len(mat))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            s = math.exp(sum((mat[i] @ crf.state)[y[i]] for i in range(n)) + sum(crf.chain[a, b] for a, b in zip(y, y[1:])))
            total, good = total + s, good + s * np.array(y)
        assert got == pytest.approx(good / total)


def test_rules_edges(spark):
    from sightline.llm.quality_rules import apply_rules, text_counts

    assert text_counts("a b c a b c\n\nx#\nx#") == (8, 10, 2, 1, 6) and text_counts(None) == (0, 0, 0, 0, 0)
    rows = apply_rules(odd(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and all(r.base_failed and not r.kept for r in rows if r.doc_id != 6)
    assert apply_rules(odd(spark, [])).count() == 0


def test_bad_hosts_lose_documents_that_pass_the_base_rule(spark):
    from sightline.llm.quality_rules import apply_rules

    good = " ".join(f"word{i}" for i in range(60))
    bad = {"symbols": "# $ % & " + good, "lines": good + "\nsame" * 5, "lengths": " ".join(f"overlongword{i}" for i in range(60))}
    rows = [(f"h{h}", good) for h in range(17) for _ in range(40)] + [(h, t) for h, t in bad.items() for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", h, len(t), None, None, None) for i, (h, t) in enumerate(rows)], DOC_SCHEMA)
    got = apply_rules(docs).collect()
    assert len(got) == len(rows) and not any(r.base_failed for r in got)
    assert {r.host for r in got if not r.kept} == set(bad) and {r.host for r in got if r.kept} == {f"h{h}" for h in range(17)}


def test_leaks_equal_brute_force(spark, documents):
    from sightline.llm.decontaminate import clean, leaks

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    ws = item.text.split()
    near = " ".join(["start"] * 9 + ws[:-1] + ["other"] + ["end"] * 9)
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(900_001, near), (900_002, None), (900_003, ""), (None, item.text)], "doc_id long, text string"))
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = {r.item_id: cut(r.text) for r in bench.collect()}
    want = set()
    for r in docs.where("doc_id is not null and text is not null").collect():
        text = " " + " ".join(cut(r.text)) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if len(w) >= 5 and f" {' '.join(w)} " in text}
    found = leaks(docs, bench)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert want <= set(got) and (900_001, item.item_id) in got and got[(900_001, item.item_id)].similarity < 1
    assert all(r.similarity >= 0.8 for r in got.values())
    assert clean(docs, bench).where("doc_id is not null").count() == docs.where("doc_id is not null").count() - len({d for d, _ in got})
    assert leaks(docs, bench.limit(0)).count() == 0 and leaks(docs.limit(0), bench).count() == 0


def test_no_similar_window_is_lost(spark):
    from sightline.llm.decontaminate import RADIUS, leaks

    def masses(w):
        out = {}
        for i in range(len(w) - 4):
            out[tuple(w[i : i + 5])] = out.get(tuple(w[i : i + 5]), 0) + sum(map(len, w[i : i + 5]))
        return out

    bench, rng, rows, want = spark.read.parquet(f"{SMALL}/benchmark.parquet"), random.Random(3), [], {}
    for r in bench.orderBy("item_id").collect():
        w = [x for x in re.split(r"[\W_]+", r.text.lower()) if x]
        for _ in range(60):
            v = list(w)
            for i in rng.sample(range(len(v)), rng.randint(1, min(3, len(v)))):
                v[i] = f"other{rng.randrange(10**6)}"
            x, y = masses(v), masses(w)
            shared = sum(min(m, y.get(k, 0)) for k, m in x.items())
            similarity = shared / max(1, sum(x.values()) + sum(y.values()) - shared)
            rows.append((len(rows), " ".join(v)))
            if similarity >= 0.8:
                want[(len(rows) - 1, r.item_id)] = similarity
    got = {(r.doc_id, r.item_id): r for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert len(want) > 100 and set(want) <= set(got) and all(got[k].similarity >= s - 1e-9 for k, s in want.items())
    assert 15 < max(r.distance for r in got.values()) <= RADIUS


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import public_tokenizers as P

    from sightline.llm import bpe

    enc = bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["", "Hello's wörld  \n\n x", " " * 9000 + "a", "ab \n" * 60_000, "é" * 150_000 + " tail", "a" + "\n" * 5000, "x 　　y" * 20_000, "<|endoftext|>"]
    for t in texts:
        ids = enc.encode(t)
        assert ids == enc.encoding.encode_ordinary(t) and enc.decode_bytes(ids) == t.encode()
    huge = "a" + "\n" * 3_000_000 + "b"
    assert enc.decode_bytes(enc.encode(huge)) == huge.encode()
    rows = bpe.encode_documents(odd(spark, EDGES), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(EDGES) and rows[0].n_tokens == 0 and rows[0].ids == []


def test_html_main_text(spark):
    from sightline.llm.html_text import extract, main_text

    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><ul class="menu"><li><a href=x>Home</a></ul>
    <div class="content"><h2>Title here</h2><p>A paragraph that is long enough to be a surge point &amp; more.<p>Second <a href="q">link</a> one.
    <div class="cookie-notice">We use cookies</div><blockquote>Quote</blockquote></div>
    <div id="comments"><p>Nice post! I like this very much, a lot of text indeed to be here.</p></div><form><label>Mail</label></form><footer>(c)</footer>"""
    assert main_text(page) == "Title here\nA paragraph that is long enough to be a surge point & more.\nSecond link one.\nQuote"
    assert main_text('<nav>n</nav><article><header><h1>T</h1></header><p>x<div class="comment"><p>no</div><p>y<br>z</article><aside>s</aside>') == "T\nx\ny z"
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    rows = extract(spark.createDataFrame([(1, "u", None), (2, None, "<p>plain")], "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0), ("plain", 5)]


def test_html_tokens_as_html_has_them():
    import time

    from sightline.llm.html_text import main_text

    assert main_text("<article>..one..</article><p>Related teaser</p><article>..two..</article>") == "..one..\n..two.."
    assert main_text("<p title=don't>one") == "one" and main_text('<p class="a>b">x</p>y<p title="q>z') == "x\ny"
    assert main_text("a < b <3 c <!--> d <!---> e <!-- f --!> g <? h > i </ j > k") == "a < b <3 c d e g i k"
    assert main_text("<p a='1'b=\"2\" c = 3/>x<br/>y<input disabled>z<ScRipt>no</SCRIPT >w") == "x yzw"
    assert main_text("<p HIDDEN>a<div aria-hidden='true'>b</div><p style='display: none'>c</p><p>d") == "d"
    for text in ("<a ", "<!--", "<script", "<p title='", "<", "<div>", "</", "<p =\"x"):
        began = time.time()
        main_text(text * (1_000_000 // len(text)))
        assert time.time() - began < 5, text


def brute_sections(lines):
    """Which lines are text, by trying every window of three lines of every section."""
    if any(s > 0 for *_, s in lines):
        lines = [x if x[2] > 0 else (*x[:2], 0) for x in lines]
    marked = sorted({s for *_, s in lines if s})
    for level in (60,) if marked else (60, 1):
        out = set()
        for s in marked or [0]:
            own = [i for i, x in enumerate(lines) if x[2] == s]
            sums = [sum(lines[i][1] for i in own[a : a + 3]) for a in range(len(own))]
            for a in range(len(own)):
                if lines[own[a]][1] > 0 and sums[a] >= level:
                    dive = next((b for b in range(a, len(own)) if not sums[b]), len(own))
                    out |= set(own) if marked else set(own[a:dive])
        if out:
            break
    return [lines[i][0] for i in sorted(out or {i for i, x in enumerate(lines) if x[2]})]


def test_html_distribution_equals_brute_force():
    from sightline.llm.html_text import main_text, page_lines

    rng = random.Random(4)
    line = lambda: rng.choice(["<p>{}</p>", "<p><a href=x>{}</a></p>", "<div>{}</div>", "<nav>{}</nav>"]).format("word " * rng.choice([1, 2, 8, 30]))
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            tag = rng.choice(["", "", "article", "main", "section"])
            inner = "".join(line() for _ in range(rng.randrange(0, 7)))
            parts.append(f"<{tag}>{inner}</{tag}>" if tag else inner)
        page = "".join(parts)
        assert main_text(page).split("\n") == (brute_sections(page_lines(page)) or [""]), page


def test_html_sections_without_a_surge_are_left_out():
    from sightline.llm.html_text import main_text

    long = "A sentence of the article that is long enough to make the sums of the lines surge. "
    assert main_text(f"<main><p>Crumbs</p><article><h1>T</h1><p>{long}</p><p>End.</p></article><article><p>Teaser</p></article></main><p>{long}</p>") == f"T\n{long.strip()}\nEnd."
    assert main_text(f"<div role=main><h1>T</h1><p>{long}</p></div><p>Out</p>") == f"T\n{long.strip()}"


def test_html_keeps_every_span_that_surges():
    from sightline.llm.html_text import main_text

    links = "".join(f"<p><a href={i}>A link to page number {i}</a></p>" for i in range(4))
    long, short = "A first section with a lot of text. " * 20, "A last section, far shorter, that is none the less text of the page."
    assert main_text(f"<div><p>{long}</p>{links}<p>{short}</p></div>") == f"{long.strip()}\n{short}"
    assert main_text(f"<p>One line.</p>{links}<p>Another line.</p>") == "One line.\nAnother line."


def test_pipeline_stages_at_the_edges(spark):
    """Null, empty and repeated rows, rows of one id, extra columns of clashing names, and empty tables."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    more = spark.createDataFrame([(10**6 + (i or 0) if i else None, t, "en", None, 3) for i, t in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    left = docs.unionByName(more).withColumn("lang_pred", C.F.lit("x")).withColumn("n_lines", C.F.lit(1)).withColumn("_id", C.F.lit("y")).withColumn("component_id", C.F.lit("z"))
    for name, stage in C.STAGES:
        out = C.stored(stage(spark, left, SMALL), name)
        assert out.count() <= left.count() and (out.columns == C.COLUMNS or name == C.STAGES[-1][0]), name
        assert stage(spark, left.limit(0), SMALL).count() == 0, name
        left = out if name != C.STAGES[-1][0] else left
    assert left.count() > 20


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, left, SMALL)
        assert out.columns == C.COLUMNS, name
        out = C.stored(out, name)
        assert out.count() <= left.count()
        left = out
    last = C.STAGES[-1][1](spark, left, SMALL)
    assert last.count() == left.count() and C.run(spark, SMALL).count() == left.count() > 100


def test_long_texts_repeated_rows_and_ties(spark):
    from sightline.llm import decontaminate, html_text, language_ppm, line_dedup, warc

    line = "A line that is long enough"
    long = "\n".join([line] + [f"line number {i} of a very long text" for i in range(60_000)])
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame([(1, long), (2, line), (3, line)], "doc_id long, text string")).collect()}
    assert got == {1: (60_001, 1), 2: (1, 1), 3: (1, 0)}
    rows = line_dedup.dedup_lines(spark.createDataFrame([(7, line), (7, line), (8, line), (8, line)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in rows) == [(7, 1), (7, 1), (8, 0), (8, 0)]

    page = "<article><p>" + "word " * 300_000 + "</p><p>end</p></article>"
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, "v", "<p>x")], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_text.extract(pages).collect()) == [1, 1_500_003, 1_500_003]
    made = warc.derivatives(warc.responses_from_pages(pages))
    assert made.count() == 6 and made.select("record_id").distinct().count() == 4 and made.agg({"content_length": "max"}).first()[0] == 1_500_003

    item = "one two three four five six seven eight nine ten"
    text = "x " * 100_000 + item + " y " + item + " z" * 1000
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame([(5, text), (5, "short"), (6, item.upper())], "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in found} == {(5, 1): (100_000, 1.0), (5, 2): (100_000, 1.0), (6, 1): (0, 1.0), (6, 2): (0, 1.0)}

    model = language_ppm.build_model({"b": [b"the cat"], "a": [b"the cat"], "c": [b"der hund"]})
    assert [x[0] for x in language_ppm.identify(model, ["the cat", "cat", "der"])] == ["a", "a", "c"]
