import random
import resource
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from augury.llm import packing, queries, repair, token_counts
from augury.llm import tokens
from augury.llm.tokens import Encoder, default_tokenizer

SCHEMA = "doc_id long, text string, lang string, ids string, path string, start string"
ODD = [
    (5, "Hello  world\n\n tabs\tand  ", "en", "a", "b", "c"),
    (3, None, None, None, None, None),
    (9, "", "x", "", "", ""),
    (None, "x<|endoftext|> y # ! \"", "x", "", "", ""),
    (7, "日本語 ½ naïve\x1c \x85z", "x", "", "", ""),
    (7, "日本語 ½ naïve\x1c \x85z", "x", "", "", ""),
    (8, "the of " * 9000, "x", "", "", ""),
    (11, "日本語の文章" * 3000, "x", "", "", ""),
    (12, "ab1" * 8000, "x", "", "", ""),
    (13, "word\n" * 5000, "x", "", "", ""),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def split(made):
    ids, ends = made
    return [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


@pytest.mark.parametrize("memory", [1 << 12, 1 << 26])
def test_pieces_give_the_library_s_ids(library, spark, sf_dir, monkeypatch, memory):
    monkeypatch.setattr("augury.llm.tokens.MEMORY_BYTES", memory)
    monkeypatch.setattr("augury.llm.tokens.GROUP_BYTES", 5000)
    rng = random.Random(4)
    for alphabet in ("ab'sreétllvdm1² \n\t\r\x0b\xa0\x1c.日 <|!-\u3000à×", "a's \n.1", "x\x85é \u2003日 \n"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
        texts += ["x <|endoftext|> y 's", "don't I'll we're ''s", "<|endoftext|>", None]
        want = [e.ids for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        assert split(Encoder(default_tokenizer()).encode(pa.array(texts, pa.string()))) == want
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    mine = Encoder(default_tokenizer())
    for column in (pa.array(texts), pa.array(["cut off", *texts], pa.large_string()).slice(1)):
        assert split(mine.encode(column, 7)) == [[*ids_of(library, t), 7] for t in texts]
    assert split(mine.encode(pa.array([], pa.string()))) == []


def test_other_pre_tokenizers_are_given_whole_texts(library, tmp_path):
    import json

    made = json.loads(open(default_tokenizer(), encoding="utf-8").read())
    made["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "t.json").write_text(json.dumps(made), encoding="utf-8")
    other = Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["one two  three", "a\nb", "", "it's 1.5"]
    assert split(Encoder(str(tmp_path / "t.json")).encode(pa.array(texts))) == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_without_blanks_leave_no_memory():
    """Long pieces don't repeat: 50 MB of them, each another one, must not stay in the worker."""
    mine = Encoder(default_tokenizer())
    rng = np.random.default_rng(0)
    mine.encode(pa.array(["warm"]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(16):
        points = rng.integers(0x4E00, 0x9FA5, (1000, 1000)).astype("<u4")
        mine.encode(pa.array([row.tobytes().decode("utf-32-le") for row in points]))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
    assert mine._memory.bytes() <= 1.3 * tokens.MEMORY_BYTES


def rows_of(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return [(r.doc_id, r.text, r.lang, "", "", "") for r in docs.collect()]


def test_repair_files(spark, library, sf_dir):
    for rows, size in ((ODD, 4_000_000), (rows_of(spark, sf_dir), 40_000), ([], 10)):
        docs = spark.createDataFrame(rows, SCHEMA)
        manifest = repair.write_shards(docs, file_tokens=size)
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in repair.read_shards(manifest).collect()]
        want, at = [], 0
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
            ids = [*ids_of(library, r[1]), 2]
            want.append((r[0], at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted(got, key=lambda r: r[1]) == want, size
        if size == 40_000:
            files = manifest.collect()
            assert len(files) > 3 and sum(f.n_bytes for f in files) < 2.2 * at


def pairs_left(symbols):
    codes = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    return int(np.unique(codes, return_counts=True)[1].max(initial=0))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    cases = [
        np.zeros(0, np.uint32),
        np.full(1001, 7, np.uint32),
        np.full(1 << 20, 3, np.uint32),
        rng.integers(0, 20, 50_000).astype(np.uint32),
        rng.zipf(1.3, 30_000).clip(0, 50_000).astype(np.uint32),
        np.tile(rng.integers(0, 60_000, 90), 400).astype(np.uint32),
        np.tile(rng.permutation(20_000), 100).astype(np.uint32),
        np.tile(np.array([1, 2, 2, 1, 2**31 - 1, 70_000], np.uint32), 5000),
        rng.integers(0, 2**31, 5000).astype(np.uint32),
    ]
    for ids in cases:
        first = int(ids.max(initial=0)) + 1
        symbols, rules, lengths = repair.compress(ids)
        assert (repair.expand(symbols, rules, first) == ids).all()
        assert (repair.expand_all(symbols, rules, lengths, first) == ids).all()
        assert pairs_left(symbols) < repair.LEAST_COUNT
        assert [len(repair.expand(np.array([first + k], np.uint32), rules, first)) for k in range(0, len(rules), 997)] == lengths[::997].tolist()
        data = repair.pack_file([1], np.array([len(ids)]), ids)
        read = []
        file = repair.File(lambda start, size, data=data, read=read: read.append(size) or data[start : start + size])
        for start, length in ((0, 10), (len(ids) // 3, 777), (max(0, len(ids) - 5), 5), (len(ids) // 2, 0)):
            assert (file.decode(start, length) == ids[start : start + length]).all()
        if len(symbols) > 20_000:
            read.clear()
            file.decode(len(ids) // 2, 100)
            assert sum(read) < len(data) / 2
    with pytest.raises(ValueError):
        repair.of_bytes(b"something else")


def test_replaced_occurrences_are_a_maximal_set():
    rng = np.random.default_rng(5)
    for _ in range(300):
        places = np.flatnonzero(rng.random(60) < 0.7)
        weight = rng.integers(1, 5, len(places))
        chosen = set(places[repair._chosen(places, weight)].tolist())
        assert all(p + 1 not in chosen for p in chosen)
        assert all(chosen & {p - 1, p, p + 1} for p in places.tolist())


def test_token_counts(spark, sf_dir):
    plain = Tokenizer.from_file(default_tokenizer())
    plain.encode_special_tokens = True
    for rows, size in ((ODD, 100), (rows_of(spark, sf_dir), 50_000), ([], 10)):
        got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), file_tokens=size).collect()
        want = [(r[0], len(ids_of(plain, r[1]))) for r in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    want, files = [], []
    for k, rate in enumerate((0.0, 0.01, 0.5, 1.0)):
        ids = np.where(rng.random(997) < rate, 9, 1).astype("<u2")
        (tmp_path / f"{k}").write_bytes(ids.tobytes())
        files.append((f"file://{tmp_path}/{k}", 2 * len(ids)))
        start = 0
        ends = np.flatnonzero(ids == 9).tolist()
        for n, end in enumerate(ends):
            want.append((files[-1][0], n, start, end - start, True))
            start = end + 1
        if start < len(ids):
            want.append((files[-1][0], len(ends), start, len(ids) - start, False))
    (tmp_path / "empty").write_bytes(b"")
    files.append((f"file://{tmp_path}/empty", 0))
    got = token_counts.scan(spark.createDataFrame(files, "path string, n_bytes long"), end_id=9, block_ids=64, kind="<u2")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def check_packing(library, rows, pieces, end, limits):
    max_tokens, max_segments, max_loss = limits
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= max_tokens and len(ps) <= max_segments and sum(p.loss_tokens for p in ps) <= max_loss
    wanted = defaultdict(list)
    for r in rows:
        wanted[r[0]].append([*ids_of(library, r[1]), end])
    for doc, texts in wanted.items():
        ps = sorted(by_doc[doc], key=lambda p: p.start)
        assert sum(p.length for p in ps) == sum(map(len, texts))
        if len(texts) == 1:
            ids, at = texts[0], 0
            for p in ps:
                assert p.start == at and p.doc_tokens == len(ids)
                assert np.frombuffer(bytes(p.ids), "<u4").tolist() == ids[at : at + p.length]
                at += p.length
    return len(by_sequence)


def test_packing(spark, library, sf_dir):
    rows = rows_of(spark, sf_dir)
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    n = check_packing(library, rows, pieces, 0, (1024, 64, 1024))
    assert n <= 1.02 * sum(p.length for p in pieces) / 1024 + 1
    check_packing(library, ODD, packing.pack(spark.createDataFrame(ODD, SCHEMA)).collect(), 0, (1024, 64, 1024))
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_pieces(n, loss, max_tokens, max_loss):
    out, at = [], 0
    while at < n:
        free = max(0, n - loss - at)
        size = min(max_tokens, n - at, free + max_loss)
        out.append((at, size, max(0, size - free)))
        at += size
    return out


def test_pieces_by_brute_force():
    rng = np.random.default_rng(3)
    for max_tokens, max_loss in ((10, 10), (10, 4), (7, 1), (5, 9)):
        sizes = rng.integers(1, 60, 200)
        loss = np.minimum(sizes, rng.integers(1, 60, 200))
        got = packing._pieces(sizes, loss, max_tokens, max_loss)
        want = [(k, *p) for k, (n, b) in enumerate(zip(sizes.tolist(), loss.tolist(), strict=True)) for p in brute_pieces(n, b, max_tokens, max_loss)]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_packing_of_instruction_data(spark, library, sf_dir):
    rows = [(k, r[1], r[2], "", "", "") for k, r in enumerate(rows_of(spark, sf_dir)[:80])]
    docs = spark.createDataFrame([(*r, k % 90 if k % 7 else None) for k, r in enumerate(rows)], f"{SCHEMA}, answer int")
    pieces = packing.pack(docs, max_tokens=600, max_segments=3, max_loss=200, loss_col="answer", end_id=1).collect()
    check_packing(library, rows, pieces, 1, (600, 3, 200))
    with pytest.raises(ValueError):
        packing.pack(docs, max_segments=0)


def test_queries_give_the_contract_s_columns(spark, library, sf_dir):
    docs = {r[0]: r[1] for r in rows_of(spark, sf_dir)}
    out = queries.op8_repair_output(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {(r.doc_id, r.ids_crc32) for r in out.collect()} == {(k, crc([*ids_of(library, t), 2])) for k, t in docs.items()}
    out = queries.op10_packing(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = {k: [*ids_of(library, t), 0] for k, t in docs.items()}
    assert all(r.ids_crc32 == crc(whole[r.doc_id][r.start : r.start + r.length]) for r in out.collect())


def test_all_three_limits_bind_in_instruction_data(spark, library, sf_dir):
    rows = queries.instruction_packing(spark, sf_dir).collect()
    turns = {f"{r.conv_id}:{r.turn}": r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    by_sequence, by_example = defaultdict(list), defaultdict(int)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_example[r.example] += r.length
    assert by_example == {k: len(ids_of(library, r.text)) + 1 for k, r in turns.items()}
    for r in rows:
        end = r.start + r.length
        assert r.loss_tokens == (r.length if turns[r.example].role == "assistant" else int(end == r.doc_tokens))
    full = [(sum(p.length for p in ps), len(ps), sum(p.loss_tokens for p in ps)) for ps in by_sequence.values()]
    assert all(a <= 1024 and b <= 16 and c <= 384 for a, b, c in full)
    assert any(c > 350 and a < 900 for a, _, c in full)  # closed by its loss, not by its tokens
