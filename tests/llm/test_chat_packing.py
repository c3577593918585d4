"""Chat windows and packing: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import chat, packing, queries

ODD = ["", None, "<|im_end|>", "<\\|im_end|>\n<|", "a\nb", "\\", "<\\\\|", "😀 <|im_start|>assistant ok"]


def digests(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    plain = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)
    loss = "".join(x or "" for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(plain), len(loss), sha(loss)


def check(rows, got):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x))
    assert {r.conv_id for r in got} == set(by) and len(got) == len(by)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(by[r.conv_id])


def test_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", queries.CONTROL_TEXT), (-1, 1, "assistant", queries.CONTROL_TEXT)]
    check(rows, queries.QUERIES["op4_chat_windows"](spark, small).collect())


def test_odd_turns(spark):
    roles = ["system", "user", "assistant", None, "a\nb\\n\\", "assistant"]
    rows = [(c, t if t != 4 else None, roles[(c + t) % 6], ODD[(c * 3 + t) % len(ODD)]) for c in range(8) for t in range(6)]
    rows += [(None, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "assistant", "x" * 50_000)]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " + "word " * (t % 9)) for t in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(frame, budget=60, history=20).cache()
    check(rows, chat.read_back(windows).collect())
    assert windows.where("n_context > 0").count() > 0


def test_system_turn_is_carried(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, t, "user" if t % 2 else "assistant", "some words to say here") for t in range(1, 30)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=50, history=15).collect()
    assert len(windows) > 3 and all(w.formatted.startswith("<|im_start|>system\nbe brief<|im_end|>\n") for w in windows)
    assert all(w.formatted.count("be brief") == 1 for w in windows)


def test_no_window_costs_more_than_the_budget(spark):
    draw = np.random.default_rng(1)
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else "assistant" if t % 2 else "user", "word " * int(draw.choice([1, 5, 30, 90, 900])))
            for c in range(60) for t in range(40)]
    rows += [(100, 0, "user", "word " * 905), (100, 1, "assistant", "word " * 905), (101, 0, "user", "word " * 15), (101, 1, "assistant", "word " * 5005),
             (102, 0, "system", "word " * 600), (102, 1, "user", "hi"), (102, 2, "assistant", "word " * 100)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, window string, before int")
    windows = chat.format_windows(frame).cache()
    check(rows, chat.read_back(windows).collect())
    cost = lambda text: len(text.split()) + 5
    for w in windows.collect():
        turns = [t.split("\n", 1)[1] for t in w.formatted.split("<|im_end|>\n")[:-1]]
        assert w.estimate == sum(map(cost, turns))
        alone = w.n_turns - w.n_context == 1
        system = cost(turns[0]) if len(turns) > 1 and w.formatted.startswith("<|im_start|>system") else 0
        assert w.estimate <= chat.BUDGET or (alone and cost(turns[-1]) + system > chat.BUDGET)
    per = {c: [(w.n_turns - w.n_context, w.estimate) for w in windows.where(f"conv_id = {c}").orderBy("window").collect()] for c in (100, 101, 102)}
    assert per[100] == [(1, 910), (1, 910)] and per[101] == [(1, 20), (1, 5010)]
    assert windows.where("n_context > 1").count() > 20 and windows.where("n_turns - n_context > 3").count() > 20


def test_no_turns(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.encode_special_tokens = True
    return t


def check_packing(rows, texts, tokenizer, capacity=1024):
    sequences, by = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(r.doc_id, []).append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        found = sorted(by[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert sum(r.length for r in found) == len(ids) and (len(found) == 1 or len(ids) > capacity)
        at = 0
        for k, r in enumerate(found):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert k == 0 or r.length == capacity
            at += r.length
    total = sum(r.length for r in rows)
    return len(sequences), -(-total // capacity)


def test_packing_of_documents(spark, small, small_docs, tokenizer):
    rows = queries.QUERIES["op5_best_fit_packing"](spark, small).collect()
    used, bound = check_packing(rows, small_docs, tokenizer)
    assert used <= bound + 1


def test_packing_of_odd_texts(odd, tokenizer):
    known = odd.where("doc_id IS NOT NULL AND doc_id <> 12")
    rows = packing.pack(packing.pieces(known, queries.tokenizer_path())).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in known.collect()], tokenizer)
    everything = packing.pack(packing.pieces(odd, queries.tokenizer_path(), with_ids=True))
    assert {"doc_id", "ids", "sequence_id", "offset"} <= set(everything.columns)
    assert everything.where("piece = 0").count() == odd.count()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in everything.collect())


def test_pipeline_stage_holds_every_copy_whole(spark, tokenizer):
    long = "one two three four " * 700
    texts = [(1, long), (1, long), (2, "a short text"), (2, "a short text"), (3, None)]
    docs = spark.createDataFrame([(d, t, "xx", "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    by = {}
    for r in corpus_pipeline.best_fit_packing(spark, docs, "").collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by.setdefault((r.doc_id, r.copy), []).append(r)
    assert sorted(d for d, _ in by) == [1, 1, 2, 2, 3] and len({c for _, c in by}) == 5
    wanted = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in texts}
    for (d, _), rows in by.items():
        assert b"".join(r.ids for r in sorted(rows, key=lambda r: r.piece)) == wanted[d]


def test_parts_with_gaps_exchange(spark):
    random = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(random.integers(200, 520, 600))]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    apart = packing.pack(cut, per_partition=40, rounds=1).agg(F.countDistinct("sequence_id")).first()[0]
    packed = packing.pack(cut, per_partition=40, rounds=4)
    assert packed.count() == 600
    check_packing(packed.collect(), [], None)
    assert packed.agg(F.countDistinct("sequence_id")).first()[0] <= apart


def test_lower_bound_holds():
    random = np.random.default_rng(1)
    for _ in range(200):
        lengths = random.integers(1, 1025, random.integers(1, 40))
        bins = packing.best_fit_decreasing(lengths, 1024)
        assert np.bincount(bins, weights=lengths).max() <= 1024
        assert packing.lower_bound(lengths, 1024) <= bins.max() + 1
    assert packing.lower_bound(np.array([600] * 7), 1024) == 7


def test_no_documents(none):
    assert packing.pack(packing.pieces(none, queries.tokenizer_path())).count() == 0


def test_new_pieces_are_merged_once(monkeypatch):
    """A new piece asks only for its merges, and forgetting rare pieces keeps those met since the last time."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    encoder = packing.Encoder(queries.tokenizer_path())
    texts = ["often " + " ".join(f"new{chr(97 + i)}{chr(97 + j)}" for j in range(20)) for i in range(20)]
    texts += ["it's \t two\n\n lines\x85é\xa0ß\xad 12½ ~\x7f\x01<|endoftext|>", "".join(map(chr, [*range(9, 14), *range(32, 0x250)]))]
    want = [encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    whole, merged, merge = encoder.tokenizer, [], encoder.merge

    class NoTokenizer:
        def encode(self, text, **options):
            assert encoder.other(text), "a piece went to the whole tokenizer"
            return whole.encode(text, **options)

    def counted(piece):
        merged.append(piece)
        return merge(piece)

    encoder.tokenizer, encoder.merge = NoTokenizer(), counted
    assert not any(map(encoder.other, texts))
    assert [np.frombuffer(encoder.ids(text), "<u4").tolist() for text in texts] == want
    assert merged.count("often") == 1 and len(encoder.known) < 200
