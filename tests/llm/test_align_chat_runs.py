"""Alignment, chat formatting and periodic runs against brute force; defined results at the edges."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

SMALL = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC_SCHEMA = "doc_id long, text string, lang string, row long, a long, b long, best string, n_docs long, start string, runs string"


def odd(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x", 4, "y", "z") for i, t in rows], DOC_SCHEMA)


EDGES = [(1, None), (2, ""), (3, "  \n\t"), (None, "a b a b a b a b a b"), (4, "naïve <|endoftext|> ▁ text"), (5, "one two"), (5, "one two"), (6, "word " * 20_000), (7, "x"), (8, "\x00   é 漢字 🙂\n\n\n  y")]


# --- op11 -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute_alignment(rows, libraries):
    """Byte by byte, with the libraries of both files."""
    a, b = libraries
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x]
    symbol = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    done, docs_of = [], Counter()
    for i, text in rows:
        raw = (" " + text).encode() if text else b""
        ai = a.encode(" " + text, add_special_tokens=False).ids if text else []
        bi = b.encode(text) if text else []
        at = [bytes(symbol[c] for c in a.id_to_token(t)) for t in ai]
        bt = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := b.id_to_piece(t)) else p.replace("▁", " ").encode() for t in bi]
        if not text or b"".join(at) != raw or b"".join(bt) != raw:
            done.append((i, [], [], [], ""))
            continue
        ca, cb = ([n for n, t in enumerate(side) for _ in t] for side in (at, bt))
        links = sorted(set(zip(ca, cb, strict=True)))
        groups, ga, gb = [], [ca[0]], [cb[0]]
        for x, y, nx, ny in zip(ca, cb, [*ca[1:], None], [*cb[1:], None], strict=True):
            ga, gb = ga + [x] * (x != ga[-1]), gb + [y] * (y != gb[-1])
            if nx != x and ny != y:
                groups.append(",".join(str(ai[n]) for n in ga) + "|" + ",".join(str(bi[n]) for n in gb))
                ga, gb = [nx], [ny]
        pairs = [(ai[x], bi[y]) for x, y in links]
        docs_of.update(set(pairs))
        done.append((i, ai, bi, pairs, ";".join(groups)))
    most = {}
    for (x, _), n in docs_of.items():
        most[x] = max(most.get(x, 0), n)
    return sorted((str(i), len(ai), len(bi), text.count(";") + 1 if text else 0, len(pairs), sum(docs_of[p] == most[p[0]] for p in pairs), sum(docs_of[p] for p in pairs),
                   hashlib.sha256(text.encode()).hexdigest() if text else "") for i, ai, bi, pairs, text in done)


def aligned(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.mark.parametrize("broadcast_pairs", [2_000_000, 0])
def test_alignment_equals_brute_force(spark, libraries, broadcast_pairs):
    from sightline.llm.token_alignment import align_corpus

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60).collect()] + EDGES
    got = align_corpus(odd(spark, rows).repartition(3), A_PATH, B_PATH, public_tokenizers.PATTERN, broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert aligned(got) == brute_alignment(rows, libraries)


def test_alignment_of_no_documents(spark):
    from sightline.llm.token_alignment import align_corpus

    assert align_corpus(odd(spark, []), A_PATH, B_PATH, public_tokenizers.PATTERN).collect() == []


def test_rank_encoder_equals_the_file_of_merges(libraries):
    """Every code point beside letters, digits, spaces and itself; so both split words at the same places."""
    from sightline.llm.token_alignment import ByteLevelFile

    mine = ByteLevelFile(A_PATH, public_tokenizers.PATTERN)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = "".join(f" a{chr(c)}1 {chr(c)}{chr(c)} {chr(c)}'s{chr(c)}." for c in points[at : at + 64])
        assert mine.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids, hex(points[at])


def test_bitset_ranks_and_cuts():
    import numpy as np

    from sightline.llm.token_alignment import Alignment, EndBits

    rng = np.random.default_rng(5)
    for _ in range(30):
        size = int(rng.integers(1, 400))
        ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(1, 80)), size)) for _ in range(2)]
        got = Alignment(*(np.diff(e, prepend=0) for e in ends))
        assert got.cuts.tolist() == sorted(set(ends[0]) & set(ends[1]))
        cover = [np.searchsorted(e, np.arange(size), side="right") for e in ends]
        assert list(zip(*(x.tolist() for x in got.links()), strict=True)) == sorted(set(zip(*(c.tolist() for c in cover), strict=True)))
        assert EndBits.of(ends[0], size).rank(np.arange(size + 1)).tolist() == [int((ends[0] <= x).sum()) for x in range(size + 1)]


# --- op12 -------------------------------------------------------------------------------------------------

LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "u1"}, {"text": "u2"}]}]}, "message_parts", [("user", "u1u2")]),
    ({"id": 7, "system": "s", "conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, "conversations", [("system", "s"), ("user", "u"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": None}]}, "conversations", [("user", "")]),
    ({"prompt": "u", "completion": "a", "meta": {"n": [1, 2]}}, "prompt_completion", [("user", "u"), ("assistant", "a")]),
    ({"response": "a", "prompt": "u", "system": ""}, "prompt_response", [("user", "u"), ("assistant", "a")]),
    ({"question": "u", "answer": 4}, "question_answer", [("user", "u"), ("assistant", "4")]),
    ({"instruction": "do", "input": "this", "output": "a"}, "instruction", [("user", "do\n\nthis"), ("assistant", "a")]),
    ({"instruction": "do", "input": "", "output": "a"}, "instruction", [("user", "do"), ("assistant", "a")]),
    ({"instruction": "do", "output": "a"}, "instruction", [("user", "do"), ("assistant", "a")]),
    ({"turns": [{"role": None, "text": "t", "turn": 3}]}, "turns", [("", "t")]),
    ({"messages": []}, "messages", []),
    ({"prompt": "u", "completion": "a", "messages": [{"role": "user", "content": "u"}]}, None, []),
    ({"other": 1}, None, []),
    ([1], None, []),
]


def test_layouts_become_canonical_turns(spark):
    from sightline.llm.chat_format import format_chats, read_back

    records = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(98, None), (98, "{not json"), (None, "")]
    got = format_chats(spark.createDataFrame(records, "conv_id long, record string")).collect()
    by_id = {r.conv_id: r for r in got}
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert (by_id[i].layout, [tuple(t) for t in by_id[i].turns], read_back(by_id[i].formatted)) == (layout, turns, turns), i
    assert len({by_id[i].fingerprint for i in (0, 1, 2, 4, 5, 6, 7, 10)}) == 8
    rest = [r for r in got if r.conv_id in (98, None)]
    assert len(rest) == 3 and all((r.layout, r.turns, r.formatted, r.loss_spans) == (None, [], "", []) for r in rest)


def test_control_strings_are_escaped_and_come_back():
    from sightline.llm.chat_format import CONTROL, escape, read_back, render, unescape

    rng = random.Random(4)
    pieces = [*CONTROL, *(c[0] + "\\" + c[1:] for c in CONTROL), *(c[1:] for c in CONTROL), "<", "[", "\\", "\\\\", "|", "a", "\n", "é🙂"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)
        turns = [(rng.choice(["user", "assistant", text]), "".join(rng.choices(pieces, k=rng.randrange(6)))) for _ in range(rng.randrange(4))]
        formatted, spans = render(turns)
        assert read_back(formatted) == turns
        assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_conversations_digest(spark):
    from sightline.llm.chat_format import digests, format_chats, gather

    rows = [(1, 1, "assistant", "</s>[INST] a"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "y"), (3, 5, "assistant", "long " * 50_000), (3, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in digests(format_chats(gather(df))).collect()}
    want = {1: [("user", ""), ("assistant", "</s>[INST] a")], 2: [("", "x"), ("", "x")], None: [("assistant", "y")], 3: [("assistant", ""), ("assistant", "long " * 50_000)]}
    assert set(got) == set(want)
    for key, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digests(format_chats(gather(df.limit(0)))).collect() == []


# --- op13 -------------------------------------------------------------------------------------------------


def brute_runs(words, min_length=6, exponent=4):
    """Every period of every stretch."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        at = q
        while at < n:
            end = at
            while end < n and words[end] == words[end - q]:
                end += 1
            start, length = at - q, end - at + q
            if end > at and length >= max(min_length, exponent * q) and not any(all(words[i] == words[i - p] for i in range(start + p, end)) for p in range(1, q)):
                out.append((start, length, q))
            at = max(end, at) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("min_length", "exponent"), [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(min_length, exponent):
    from sightline.llm.periodic_runs import collapse

    rng = random.Random(11)
    texts = []
    for n in range(400):
        words = rng.choices("ab" if n % 3 else "abcde", k=rng.randrange(30))
        for _ in range(rng.randrange(3)):
            unit = rng.choices("abcd", k=rng.randrange(1, 7))
            words += (unit * 9)[: rng.randrange(1, 9 * len(unit))] + rng.choices("xyz", k=rng.randrange(3))
        texts.append(" ".join(words))
    for text, (n_words, runs, kept) in zip(texts, collapse(texts, min_length, exponent), strict=True):
        words = text.split()
        want = brute_runs(words, min_length, exponent)
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert (n_words, runs, kept) == (len(words), want, " ".join(w for i, w in enumerate(words) if i not in gone))


def test_end_positions_keep_order_across_blocks():
    from sightline.llm.periodic_runs import EndPositions

    order = list(range(6000))
    random.Random(2).shuffle(order)
    mine, seen = EndPositions(), []
    for x in order:
        before, after = mine.add(x)
        if len(seen) < 400:
            assert (before, after) == (max((y for y in seen if y < x), default=None), min((y for y in seen if y > x), default=None))
        seen.append(x)
    assert list(mine) == list(range(6000)) and mine.size == 6000 and len(mine.blocks) > 1


def planted_words(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_documents(spark):
    from sightline.llm.periodic_runs import digests, find_runs, plant

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 6000] + EDGES
    tenth = [i for i in range(4000, 4400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, t) for i in tenth[:20] for t in ("a b\tc d\x0be f g h i j k l m n o p", None, " ", "x")]
    rows += [(tenth[21], " ".join(f"w{i % 977}" for i in range(20_000)))]  # a long text, all one run
    got = sorted((str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in digests(find_runs(plant(odd(spark, rows).repartition(3)))).collect())
    want, some = [], 0
    for i, text in rows:
        words = planted_words(i, text)
        runs = brute_runs(words) if len(words) < 1500 else [(0, 20_000, 1)] if words[0] == b"word" else None
        if runs is None:  # the run of the long text, seen to be right by its definition
            a, p = (zlib.crc32(str(i).encode()) // 10) % 20_000, 0
            g = zlib.crc32(str(i).encode()) // 10
            p = 1 + (20_000 - a) // (3 + g % 8)
            tail = [w == words[k + a] for k, w in enumerate(words[a + p :])]
            assert all(tail)
            want.append(None)
            continue
        some += bool(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((str(i), len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    assert some >= 10
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r for r in got if r[0] != str(tenth[21])), key=key) == sorted((r for r in want if r), key=key)
    assert digests(find_runs(plant(odd(spark, [])))).collect() == []
