import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from marlpit.llm.packing import Packer, Piece, pack
from marlpit.llm.tokens import Encoder, count_tokens, default_vocabulary

TEXTS = ["", None, "one line", "a\n\nb\n", "é" * 5 + "\nnaïve — 漢字\n" * 3, "x" * 3000, "word " * 2500, "a <|endoftext|> b", "\n", "same", "same"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_ids_of_the_json_file(reference):
    coder = Encoder(default_vocabulary())
    for t in TEXTS:
        assert coder.ids(t or "").tolist() == ids(reference, t)


def test_long_runs_of_space(reference):
    coder = Encoder(default_vocabulary())
    for run in (" " * 2000, " \n" * 1500, "\u3000" * 2500, "\t" * 1999 + " "):
        for t in (run, "a" + run, run + "b", "a" + run + "b " + run + "!c", run + "\x1c", "x" + run + "<|endoftext|>"):
            assert coder.ids(t).tolist() == ids(reference, t), repr(t[:5])
    assert len(coder.ids(" " * 3_000_000 + "end")) > 1


def docs(spark):
    return spark.createDataFrame([(i if i < 10 else None, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, section string").repartition(2)


def test_line_counts_match_offsets(spark, reference):
    got = defaultdict(dict)
    for r in count_tokens(docs(spark)).collect():
        got[r.doc_id][r.section] = (r.start, r.end, r.tokens)
    for i, t in enumerate(TEXTS):
        t = t or ""
        lines = t.splitlines(keepends=True) if "\n" in t else [t]
        e, at, want = reference.encode(t, add_special_tokens=False), 0, {}
        for k, line in enumerate(lines):
            want[k] = (at, at + len(line), sum(at <= a < at + len(line) for a, _ in e.offsets))
            at += len(line)
        assert got[i if i < 10 else None] == want, t


@pytest.mark.parametrize("rule", ["first", "last", "most", "split"])
def test_fields_add_up(spark, reference, rule):
    rows = spark.createDataFrame([(1, "ab", "cd e"), (2, None, "x\n\n\ny"), (3, None, None)], "doc_id int, title string, body string")
    got = defaultdict(float)
    for r in count_tokens(rows, fields=["title", "body"], rule=rule).collect():
        got[r.doc_id] += r.tokens
    assert got == {k: pytest.approx(len(ids(reference, f"{a or ''}\n{b or ''}"))) for k, a, b in rows.collect()}


def test_pieces_hold_each_id_once(spark, reference):
    rows = pack(docs(spark), with_ids=True, tokens=64, segments=3).collect()
    sequences, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.input_ids, "<u4").tobytes()) and r.length == len(r.input_ids) == r.loss_tokens
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id not in (9, None):
            parts[r.doc_id].append((r.start, r.input_ids, r.doc_tokens))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64 and len(s) <= 3
    for i, t in enumerate(TEXTS[:9]):
        whole = [x for _, y, _ in sorted(parts[i]) for x in y]
        assert whole == [*ids(reference, t), 0] and {n for *_, n in parts[i]} == {len(whole)}
    assert sum(r.doc_id in (9, None) for r in rows) >= 2
    short = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(n < 64 for n in short) <= 4
    assert pack(docs(spark).limit(0)).count() == 0 and count_tokens(docs(spark).limit(0)).count() == 0


def test_limits_hold_together_without_cuts():
    rng = np.random.default_rng(5)
    packer, bins = Packer(100, 4, 30, cut=False, window=32), []
    sizes = [(int(rng.integers(1, 120)), rng.random()) for _ in range(400)]
    for i, (n, share) in enumerate(sizes):
        bins += packer.add(Piece(i, 0, np.zeros(n, np.uint32), rng.random(n) < share / 2, n))
    bins += packer.drain()
    assert sorted(p.key for b, _ in bins for p in b) == list(range(400))
    for b, fits in bins:
        tokens, loss = sum(len(p.ids) for p in b), sum(p.bearing() for p in b)
        assert fits == (tokens <= 100 and loss <= 30) and (len(b) <= 4 if fits else len(b) == 1)


def test_tiny_pieces_fill_sequences():
    rng = np.random.default_rng(5)
    for most in (1, 3):  # single ids as those of empty texts, and a few
        packer, bins = Packer(1024, 1024, 1024, cut=True, window=512), []
        sizes = rng.integers(1, most + 1, 20_000)
        for i, n in enumerate(sizes.tolist()):
            bins += packer.add(Piece(i, 0, np.zeros(n, np.uint32), None, n))
        bins += packer.drain()
        filled = [sum(len(p.ids) for p in b) for b, _ in bins]
        assert sum(filled) == sizes.sum() and len(bins) == -(-int(sizes.sum()) // 1024)


def test_cuts_respect_the_loss_limit():
    packer, loss = Packer(50, 8, 10, cut=True, window=4), np.tile([True, False, False], 70)
    bins = [*packer.add(Piece(0, 0, np.arange(210, dtype=np.uint32), loss, 210)), *packer.drain()]
    assert all(sum(len(p.ids) for p in b) <= 50 and sum(p.bearing() for p in b) <= 10 for b, _ in bins)
    assert np.concatenate([p.ids for p in sorted((p for b, _ in bins for p in b), key=lambda p: p.start)]).tolist() == list(range(210))


def test_parts_bear_loss_by_part(spark, reference):
    rows = [(1, [("ask me", False), ("an answer", True)]), (2, [("only a question", False)]), (3, None), (4, []), (5, [(None, True), ("x " * 90, True)])]
    frame = spark.createDataFrame(rows, "conv_id long, parts array<struct<text:string,loss:boolean>>")
    got = pack(frame, "conv_id", parts="parts", tokens=64, loss_tokens=40).collect()
    want = {k: (sum(len(ids(reference, t)) for t, _ in p or []) + 1, sum(len(ids(reference, t)) for t, b in p or [] if b) + bool(p and p[-1][1])) for k, p in rows}
    assert {k: (sum(r.length for r in got if r.conv_id == k), sum(r.loss_tokens for r in got if r.conv_id == k)) for k in want} == want
    for s in {r.sequence_id for r in got}:
        assert sum(r.length for r in got if r.sequence_id == s) <= 64 and sum(r.loss_tokens for r in got if r.sequence_id == s) <= 40


@pytest.mark.parametrize("rule", ["first", "last", "most", "split"])
def test_rules_and_crossing_by_hand(spark, reference, rule):
    """Each section's tokens from the bytes that every token covers, for tokens over one or more bounds."""
    rows = [(1, "ab", "cd e", "f"), (2, "hello wor", "ld", "!"), (3, "x ", "", "   y"), (4, "é", "è\U0001f600", "z\n\n"), (5, "", "", ""), (6, None, "un", "believ")]
    frame = spark.createDataFrame(rows, "doc_id int, a string, b string, c string")
    got = {(r.doc_id, r.section): (r.name, r.tokens, r.crossing) for r in count_tokens(frame, fields=["a", "b", "c"], rule=rule, separator="").collect()}
    coder = Encoder(default_vocabulary())
    crossed = 0
    for key, *parts in rows:
        parts = [(p or "").encode() for p in parts]
        bounds = [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(3)]
        tokens, crossing, at = [0.0] * 3, [0] * 3, 0
        for size in coder.lengths[coder.ids(b"".join(parts).decode())].tolist():
            shares = [max(0, min(at + size, e) - max(at, s)) for s, e in bounds]
            touched = [i for i in range(3) if shares[i]]
            if len(touched) > 1:
                for i in touched:
                    crossing[i] += 1
            if rule == "split":
                tokens = [t + x / size for t, x in zip(tokens, shares, strict=True)]
            else:
                tokens[{"first": touched[0], "last": touched[-1], "most": max(touched, key=lambda i: (shares[i], -i))}[rule]] += 1
            at += size
        crossed += sum(crossing)
        for i in range(3):
            assert got[key, i] == ("abc"[i], pytest.approx(tokens[i]), crossing[i]), (key, i)
    assert crossed


def test_refused_key_names(spark):
    frame = spark.createDataFrame([(1, "a")], "start int, text string")
    for operator in (pack, count_tokens):
        with pytest.raises(ValueError, match="rename"):
            operator(frame, key="start")
