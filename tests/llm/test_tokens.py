import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from corrvox.llm import packing, token_files
from corrvox.llm.tokens import WordEncoder

ODD = ["a  b\n c\td", " x y ", "\n\n", "a b c", "don't  stop\r\nnow", "x \n y", "é́ áb", "ﬁ İ ΑΣ ΣΑ", "<|endoftext|> <|startoftext|>x", "", None, "a\x1cb c\x1c d", "a\x00 b c", "日本語 テキスト　全角", "'s 't 'll x's", "123 45 6", "word, word. Word; ... word!,", "w\x01 \x01 x"]


ODD += ["\xa0", " ", "\u2028", "\x85", "Section\t1a-1b, it's 201 a-b", "a <|endoftext|> b", "a\n<|endoftext|>\nb", "<|endoftext|>", "<|startoftext|><|endoftext|>", "x<|endoftext|>,", "BELEDİYESİ. Ankara", "İ.", "İ", "ŉ, ĸ.", " \u0301a", "a \u0301. b", "ß.,;:!? É,", "<|END|>"]


@pytest.mark.parametrize("special_text", [False, True])
@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_same_ids_as_the_library(name, drops, special_text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    truth = Tokenizer.from_file(path)
    if special_text:
        truth.encode_special_tokens = True
    rng = random.Random(3)
    parts = [*"ab c'. \n\t é1́\r\x1c\x85 S\x00Σ,İ.\xa0", "<|endoftext|>", " <|endoftext|>", "İ. ", "é, ", " it's", "\n"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = [[*truth.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    for memo in (400_000, 20, 2):  # a small memo forgets, and nothing changes
        w = WordEncoder(path, drops, memo=memo, special_text=special_text)
        for k in range(0, len(texts), 700):
            part = pa.array([None, *texts])[1 + k : 1 + k + 700]  # a slice, not from the array's beginning
            flat, starts = w.column(part)
            for t, a, z, x in zip(part.to_pylist(), starts[:-1], starts[1:], want[k:], strict=False):
                assert flat[a:z].tolist() == x, repr(t)
        assert len(w.words) <= max(memo, 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in w.ids(texts[:60])] == want[:60]
    bare = WordEncoder(path, drops, end=None, special_text=special_text)
    assert [np.frombuffer(x, "<u4").tolist() for x in bare.ids(texts[:60])] == [x[:-1] for x in want[:60]]
    # Every text alone in its chunk.
    for t, x in zip(ODD, want, strict=False):
        assert np.frombuffer(bare.ids([t])[0], "<u4").tolist() == x[:-1], repr(t)


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_a_word_is_learnt_once_whatever_mark_follows(name, drops):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    truth, rng = Tokenizer.from_file(path), random.Random(4)
    words = ["".join(rng.choice("abcdeéßñçIŉĸ") for _ in range(12)) for _ in range(1500)]
    texts = [" ".join(f"{w}{m}" for w in words) for m in ("", ".", ",", "!?", ".,'s", ";'s.x")] + ["  ".join(f"{w}:" for w in words)]
    enc = WordEncoder(path, drops)
    seen = []
    learn = enc._learn
    enc._learn = lambda pieces: (seen.extend(pieces), learn(pieces))[1]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == [[*truth.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert len(seen) <= 2 * 1500 + 40  # at most as the first word of a text and after a space; "'s" and marks besides


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_in_the_alphabet_of_bytes(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    truth = Tokenizer.from_file(path)
    letters = [chr(c) for c in [*range(0xC0, 0x250)] if c not in (0xD7, 0xF7, 0x130)]
    texts = [f"{c} x{c}, {c}." for c in [*map(chr, range(65, 91)), *letters]]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(path, name.startswith("word")).ids(texts)] == [[*truth.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_a_special_token_with_a_mark_stays_whole(tmp_path):
    from tokenizers import Tokenizer

    truth, path = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "t.json")
    truth.add_special_tokens(["<end.of>"])
    truth.save(path)
    texts = ["a<end.of>b, c. d", "  x<end.of>,", "end.of"]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(path, False).ids(texts)] == [[*truth.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_frames_round_trip_and_damage():
    rng = np.random.default_rng(1)
    docs = [(k if k != 3 else None, rng.integers(0, 50000, n)) for k, n in enumerate((5, 0, 4000, 17, 1, 900))]
    out = io.BytesIO()
    w = token_files.FrameWriter(out, wide=False, frame_ids=1000)
    for part in (docs[:2], docs[2:]):
        starts = np.concatenate([[0], np.cumsum([len(i) for _, i in part])])
        w.add(np.array([k or 0 for k, _ in part]), np.array([k is None for k, _ in part]), np.concatenate([i for _, i in part]), starts)
    size = w.close()
    data = out.getvalue()
    assert size == len(data)
    r = token_files.FrameReader(io.BytesIO(data), size)
    assert len(r.table) >= 3
    for (_, ids), row in zip(docs, r.index, strict=True):
        assert (r.ids(row) == ids).all()
    assert (r.get(2)[0] == docs[2][1]).all() and r.get(99) == [] and r.index["null"].tolist() == [0, 0, 0, 1, 0, 0]
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises(Exception):
        token_files.FrameReader(io.BytesIO(bytes(broken)), size).get(0)
    with pytest.raises(ValueError):
        token_files.FrameReader(io.BytesIO(b"x" * 40), 40)


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, f"text number {k} <|endoftext|>" * (k % 5), "x") for k in range(40)] + [(50, "long words " * 30_000, "x")] + [(7, "again", "x"), (100, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    got = token_files.read_token_files(spark, token_files.write_token_files(df, path, parts=4)).orderBy("start").collect()
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(path), 0
    for r, (d, t, _) in zip(got, sorted(rows, key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (d, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(spark, token_files.write_token_files(empty, path)).count() == 0


def test_best_fit_and_plan():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 101, 300)
        bins, places, fills = packing.best_fit(sizes, 100)
        assert fills.max() <= 100 and fills.sum() == sizes.sum()
        for b in range(len(fills)):
            own = np.argsort(places[bins == b])
            assert (np.cumsum(sizes[bins == b][own]) - sizes[bins == b][own] == places[bins == b][own]).all()
        values, counts = np.unique(sizes, return_counts=True)
        plan = packing.plan_counts(dict(zip(values.tolist(), counts.tolist(), strict=True)), 100)
        used = np.zeros(101, int)
        for inside, many in plan:
            assert sum(inside) <= 100
            for s in inside:
                used[s] += many
        assert (used[values] == counts).all() and sum(m for _, m in plan) <= len(fills) + 1


def test_best_fit_is_best_fit():
    """Bin by bin as the definition says: the fullest bin that has room, else a new one."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 61, int(rng.integers(0, 200)))
        bins, places, fills = packing.best_fit(sizes, 60)
        want: list[int] = []
        inside: dict[int, list[int]] = {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [f for f in want if f + sizes[i] <= 60]
            if fits:
                want[want.index(max(fits))] += int(sizes[i])
            else:
                want.append(int(sizes[i]))
        assert sorted(want) == sorted(fills.tolist())
        for b, p, n in zip(bins.tolist(), places.tolist(), sizes.tolist(), strict=True):
            inside.setdefault(b, []).append((p, n))
        for b, held in inside.items():
            at = 0
            for p, n in sorted(held):
                assert p == at
                at += n
            assert at == fills[b]


def test_packing_levels(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 3, 9, 40, 60, 61, 99, 100])) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, length long").repartition(40)
    out = packing.pack_pieces(df, capacity=100, nearly=2, fan_in=4).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted(rows)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 100
    big = sum(1 for _, n in rows if n > 50)
    assert len(seqs) <= max(big, -(-sum(n for _, n in rows) // 100)) * 1.1 + 2


def test_pieces_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(k, t) for k, t in enumerate(["BELEDİYESİ. Ankara", "a <|endoftext|> b", "\xa0", "word, " * 700, None, "One two; three."])]
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pieces_of(spark.createDataFrame(rows, "doc_id long, text string"), path, capacity=300).collect()}
    want = {}
    for k, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for i, a in enumerate(range(0, len(ids), 300)):
            part = ids[a : a + 300]
            want[k, i] = (a, len(part), zlib.crc32(part.tobytes()))
    assert got == want


def test_pack_documents_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "x")]
    # Columns whose names clash with those of the operator are not read.
    df = spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], "doc_id long, text string, length long, node long, fill long, piece int")
    out = packing.pack_documents(df, path).collect()
    by = sorted((r.doc_id or 0, r.piece, r.length) for r in out)
    assert by == [(0, 0, 2), (1, 0, 1), (2, 0, 1), (3, 0, 2048), (3, 0, 2048), (3, 1, 2048), (3, 1, 2048), (3, 2, 905), (3, 2, 905)]
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_texts_reach_python_in_bounded_batches(spark, monkeypatch):
    from corrvox.llm.common import TEXT_ROWS, materialize
    from corrvox.llm.tokens import chunks

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(rows)

    def sizes(batches):  # a piece for each batch, as long as the batch has rows
        for b in batches:
            one = pa.array([1])
            yield pa.RecordBatch.from_arrays([one, pa.array([0], pa.int32()), pa.array([0]), pa.array([b.num_rows]), one], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = spark.range(3 * TEXT_ROWS).coalesce(1).selectExpr("id as doc_id", "'a b' as text")
    monkeypatch.setattr(packing, "pieces_of", lambda docs, *a, **kw: docs.mapInArrow(sizes, packing.PIECES))
    assert [r.length for r in packing.pack_documents(docs, "").collect()] == [TEXT_ROWS] * 3
    with pytest.raises(Exception):
        materialize(docs.selectExpr("raise_error('no')"), "fails", TEXT_ROWS)
    assert spark.conf.get(rows) == was
    # A chunk's words, ids and places take many times its bytes.
    texts = pa.array(["x" * 5_000] * 1_000 + ["y" * 3_000_000])
    got = list(chunks(texts))
    assert [a for a, _ in got] == [0, *(z for _, z in got[:-1])] and got[-1][1] == len(texts)
    assert all(z - a == 1 or (z - a) * 5_000 <= 2_000_000 for a, z in got)
