"""Packing, token files, WARC archives, language and mixing against round trips and brute force."""

from __future__ import annotations

import io
import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from loomline.llm import language, mixing, packing, token_files, tokens, warc
from loomline.llm.queries import QUERIES
from loomline.session import scratch_path
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [(5, None), (4, ""), (3, "  \n\n x"), (9, "a<|endoftext|>b"), (8, "don't \t\n\ttabs\x1c!\x1c!  nbsp  "), (2, "é½² 你好 😀 " * 900), (7, "same"), (7, "same"), (None, "no id")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def test_word_encoder_equals_library(library, rows):
    for limit in (tokens.CACHE_WORDS, 3):
        encode = tokens.WordEncoder(tokens.default_tokenizer(), limit)
        for _, t in [*rows[:60], *ODD]:
            assert encode(t) == ids_of(library, t, 0)[:-1].tobytes()


def test_texts_that_mix_white_space_equal_library(library):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert set(tokens._OTHER_SPACE) == set(spaces) - {" ", "\n", *tokens._PYTHON_ONLY_SPACE}
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab'\n\n  é1" + rng.choice(spaces)) for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    encode = tokens.WordEncoder(tokens.default_tokenizer())
    for t in ["a\xa0b\xa0c\n\n\nd", "x\ty\tw\n\n\nz", "x\ty\n", "\ra b ", *mixed]:
        assert encode(t) == ids_of(library, t, 0)[:-1].tobytes(), repr(t)


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers
    changes = {"lower": ("normalizer", normalizers.Lowercase()), "prefix": ("pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)),
               "digits": ("pre_tokenizer", pre_tokenizers.Sequence([pre_tokenizers.Digits(True), pre_tokenizers.ByteLevel(add_prefix_space=False)]))}
    for name, (part, value) in changes.items():
        changed = Tokenizer.from_file(tokens.default_tokenizer())
        setattr(changed, part, value)
        changed.save(str(tmp_path / name))
        encode = tokens.WordEncoder(str(tmp_path / name))
        for text in ("Hello World 1234\nAgain", "A\tB", ""):
            assert encode(text) == ids_of(changed, text, 0)[:-1].tobytes(), name
    assert tokens.WordEncoder(tokens.default_tokenizer()).by_rule


def test_dictionary_of_long_texts_of_texts_without_id_and_of_too_few(spark):
    words = [f"word{i}" for i in range(400)]
    rng = random.Random(9)
    path = tokens.default_tokenizer()
    for ids, n, length in ((True, 150, 1500), (False, 600, 60)):
        made = spark.createDataFrame([(i if ids else None, " ".join(rng.choices(words, k=length))) for i in range(n)], SCHEMA)
        assert len(token_files.train_dictionary(made, path, 0)) > 1000
    with pytest.warns(UserWarning, match="no dictionary"):
        assert token_files.train_dictionary(spark.createDataFrame([(1, "same")] * 50, SCHEMA), path, 0) == b""


def check_packing(found, want, library):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    texts = defaultdict(list)
    for d, t in want:
        texts[d].append(ids_of(library, t, 1))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        expected = Counter()
        for ids in texts[d]:
            for at in range(0, len(ids), 2048):
                part = ids[at:at + 2048]
                expected[at, len(part), brute.crc(part.tobytes()), len(ids)] += 1
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own) == expected
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return [sum(r.length for r in own) for own in windows.values()]


def test_packing_covers_every_id_once(spark, rows, library):
    totals = check_packing(QUERIES["op5_packing"](spark, SF_DIR).collect(), rows, library)
    assert len(totals) <= 1 + -(-sum(totals) // 2048) and sum(map(packing.padding, totals)) < 4096
    odd = spark.createDataFrame([(d, t, 1, "x") for d, t in ODD], SCHEMA + ", length int, ids string")
    pieces = packing.token_pieces(odd)
    from pyspark.sql import functions as F
    packed = packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")).collect()
    check_packing(packed, ODD, library)
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], SCHEMA))).count() == 0


def test_patterns_use_every_piece_and_fill_windows():
    rng = random.Random(1)
    for size in (1, 7, 300, 3000):
        counts = Counter(min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(size))
        patterns = packing.slack_patterns(counts)
        used = Counter()
        for taken, again in patterns:
            assert sum(k * n for k, n in taken.items()) <= 2048 and again > 0
            for k, n in taken.items():
                used[k] += n * again
        assert used == counts
    windows = sum(again for _, again in patterns)
    assert windows <= 1.01 * sum(k * n for k, n in counts.items()) / 2048 + 1


def test_first_pattern_is_closest_to_capacity():
    from itertools import product
    counts = {1300: 1, 700: 1, 350: 2, 41: 3, 13: 2}
    taken, _ = packing.slack_patterns(counts)[0]
    best = max(s for k in product(*[range(n + 1) for length, n in counts.items() if length != 1300])
               for s in [1300 + sum(a * b for a, b in zip(k, [700, 350, 41, 13]))] if s <= 2048)
    assert sum(k * n for k, n in taken.items()) == best


def test_token_files_return_every_id(spark, rows, library):
    found = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, SF_DIR).collect()}
    start = 0
    for d, t in sorted(rows):
        ids = ids_of(library, t, 0)
        r = found.pop(d)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), brute.crc(ids.tobytes()))
        start += len(ids)
    assert not found


def test_token_files_of_odd_rows_and_single_documents(spark, library):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ODD], SCHEMA + ", ids int").repartition(2)
    files = token_files.write_token_files(docs, scratch_path(spark, "tokens"))
    read = sorted((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read_token_files(spark, files).collect())
    assert [d for _, d, _ in read] == [None, 2, 3, 4, 5, 7, 7, 8, 9]
    texts = dict(ODD)
    assert all(ids == ids_of(library, texts[d], 0).tobytes() for _, d, ids in read)
    opened = [token_files.TokenFile(f) for f, _, _ in files]
    assert [ids for f in opened for ids in f.find(9)] == [ids_of(library, texts[9], 0).tobytes()]
    assert sum(len(f.find(7)) for f in opened) == 2 and sum(len(f.find(6)) for f in opened) == 0
    folder = Path(files[0][0]).parent
    (folder / "dictionary").write_bytes(b"another")
    with pytest.raises(ValueError):
        token_files.TokenFile(files[0][0])
    empty = token_files.write_token_files(spark.createDataFrame([], SCHEMA), scratch_path(spark, "tokens"))
    assert token_files.read_token_files(spark, empty).count() == 0


def check_archive(found, want):
    top: dict = {}
    for p, h in want:
        data = (h or "").encode()
        top[data] = max((x for x in (p, top.get(data)) if x is not None), default=None)
    expected = Counter()
    for p, h in want:
        data = (h or "").encode()
        refers = None if top[data] is None or p == top[data] else top[data]
        expected[p, len(data), warc.digest(data), "response" if refers is None else "revisit", refers] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected


def test_archives_return_what_was_written(spark):
    want = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "html").collect()]
    check_archive(QUERIES["op4_warc"](spark, SF_DIR).collect(), want)
    odd = [(1, "u", "same"), (2, "u\r\nEvil: 1", "same"), (3, None, None), (4, "v", ""), (None, "w", "same"), (None, "w", "alone"), (7, "x", "é\r\n\r\n" * 90_000)]
    pages = spark.createDataFrame([(*r, "c") for r in odd], "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write_archives(pages, scratch_path(spark, "warc"))
    read = warc.read_archives(spark, [f for f, _ in files]).collect()
    check_archive(read, [(p, h) for p, _, h in odd])
    assert {bytes(r.payload).decode() for r in read if r.page_id == 7} == {odd[-1][2]}
    assert [r.url for r in read if r.page_id == 2] == ["u%0D%0AEvil: 1"]
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "warc"))
    assert warc.read_archives(spark, [f for f, _ in empty]).count() == 0


def test_damaged_archives_are_refused():
    good = warc.record(1, "http://a", b"payload" * 50, 350, warc.digest(b"payload" * 50), None)
    assert len(list(warc.read_records(io.BytesIO(good + good)))) == 2
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    import gzip
    other = gzip.compress(gzip.decompress(good).replace(b"payloadp", b"qayloadp"))
    with pytest.raises(warc.WarcError):
        [warc.parse(*r) for r in warc.read_records(io.BytesIO(other))]
    longer = gzip.compress(gzip.decompress(good)[:-4] + b"x\r\n\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(longer)))


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = QUERIES["op6_language_id"](spark, SF_DIR).collect()
    assert len(found) == len(truth)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    tests = [r for r in found if r.held_out and truth[r.doc_id][0]]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in tests) >= 0.93 * len(tests)


def test_language_of_odd_texts(spark):
    train = [(i, "the cat and the dog of this house is here with that", "en") for i in range(9)] + [
        (20 + i, "der hund und die katze sind nicht in dem haus mit", "de") for i in range(9)] + [(40 + i, "это дом и там живёт кот", "ru") for i in range(9)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F
    model = language.learn(docs, F.lit(True))
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "кот и дом"), (5, "the dog is here with the cat " * 9 + "und die katze sind nicht in dem haus " * 9), (6, "x " * 30_000)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame([(*r, 1.0) for r in odd], SCHEMA + ", score double"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["und", "und", "und", "ru"]
    assert [s.lang for s in found[5].spans] == ["en", "de"] and found[5].spans[1].first == 63 and 0.4 < found[5].score < 0.6
    assert found[6].spans[0].n == 30_000
    none = language.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert language.identify(docs.limit(0).select("doc_id", "text"), model).count() == 0


def test_viterbi_equals_all_paths():
    from itertools import product
    rng = np.random.default_rng(0)
    lengths = np.array([5, 0, 3, 1])
    scores = rng.normal(0, 3, (9, 3)).astype(np.float32)
    got, at = language.viterbi(scores, lengths, 2.5), 0
    for n in lengths:
        own = scores[at:at + n]
        value = lambda p: sum(own[i, s] for i, s in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(product(range(3), repeat=int(n)), key=value)
        assert abs(value(best) - value(got[at:at + n])) < 1e-4
        at += n


def test_viterbi_in_blocks_equals_one_walk():
    rng = np.random.default_rng(1)
    for penalty in (0.5, 4.0):
        lengths = np.array([40, 0, 7, 1, 133, 8, 9])
        scores = np.round(rng.normal(0, 3, (lengths.sum(), 4)), 3).astype(np.float32)
        whole, cut = language.viterbi(scores, lengths, penalty, 1000), language.viterbi(scores, lengths, penalty, 8)
        assert (whole == cut).all()


def test_mixing_meets_targets(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = QUERIES["op9_mixing"](spark, SF_DIR).collect()
    again = QUERIES["op9_mixing"](spark, SF_DIR).collect()
    assert sorted(found) == sorted(again) and len(found) == len(docs)
    size, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r.size == len(brute.WORD.findall(docs[r.doc_id].text or "")) and r.taken <= 2 * r.size
        s = docs[r.doc_id].source
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    want = mixing.targets(dict(size))
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and target[s] <= 2 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3


def test_mixing_does_not_depend_on_the_order_of_totals(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 7}", "w " * (300 + i)) for i in range(70)], SCHEMA.replace("text", "source") + ", text string")
    width, runs, write = spark.conf.get("spark.sql.shuffle.partitions"), [], mixing.materialize
    for n in ("1", "5", "13"):
        def written(df, name, n=n):  # the totals come in another order for each number of partitions
            out = write(df, name)
            spark.conf.set("spark.sql.shuffle.partitions", n)
            return out
        monkeypatch.setattr(mixing, "materialize", written)
        try:
            found = mixing.mix(docs).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", width)
        runs.append(sorted((r.doc_id, r.taken, [(p["first"], p["n"], sorted(p["shards"])) for p in r.pieces]) for r in found))
    assert runs[0] == runs[1] == runs[2]


def test_mixing_of_small_sources_meets_targets(spark):
    docs = spark.createDataFrame([(1, "a", "w " * 60), (2, "b", "w " * 300), (3, "c", "w " * 5), (4, "d", "w " * 5000)], "doc_id long, source string, text string")
    for r in mixing.mix(docs, share=1.2).collect():
        assert abs(r.taken - r.target) <= max(1, r.source_size / 32), r


def test_mixing_of_odd_rows(spark):
    rows = [(1, "b", "w " * 700), (1, "b", "w " * 700), (None, "b", "a b c"), (2, None, "x y z"), (3, "a", None), (4, "a", ""), (5, "é", "q " * 90)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, target int")
    mixed = mixing.mix(docs, keep=("text",))
    out = mixed.collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    written = Counter()
    for r in mixing.mixed_texts(mixed).collect():
        written[r.source] += len(brute.WORD.findall(r.text))
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    assert +written == +taken
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_share_what_is_left():
    got = mixing.targets({"a": 100, "b": 1000, None: 10})
    assert got["a"] == 200 and got[None] == 20 and abs(got["b"] - (1.5 * 1110 - 220)) < 1e-9


def test_permutations_and_draws():
    for size in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, 5)) == list(range(size))
    drawn = mixing.shard_draws([10, 0, 1000], 8, 1)
    assert (drawn.sum(0) == [10, 0, 1000]).all() and (drawn >= 0).all()
    assert json.dumps(drawn.tolist()) == json.dumps(mixing.shard_draws([10, 0, 1000], 8, 1).tolist())
