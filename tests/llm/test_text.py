"""Token counts, language and byte-level BPE against the libraries and by hand."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirrortab.llm import byte_bpe, language, token_count
from mirrortab.llm.arrays import balanced, flat

PARTS = ["'s", "s", "re", "'re", "'ll", "v", " ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "²", "Ⅷ", "!", "#", "$", "<|endoftext|>", "日本",
         " ", "　", "\x1c", "\x85", "😀", "t", "m", "'S", "​", "_", " the", ", and", "Σ", "é"]


def strings(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def reference_bpe():
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_those_of_the_library(name):
    texts = strings(3000) + ["", "x" * 5000, "word " * 3000, "a b\n" * 50]
    if name.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        want = [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        from tokenizers import Tokenizer
        want = [len(x) for x in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert token_count.counts_of(P.path(name), texts).tolist() == want


def test_counts_of_odd_tables(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "", 8), (2, "hello world " * 40000, 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int").withColumn("kept", F.lit("x")).withColumn("n", F.lit(1))
    out = token_count.token_counts(df, "text", P.path(token_count.VOCABULARY), slice_bytes=1000)
    assert out.columns == ["doc_id", "kept", "n", "n_tokens"]
    found = sorted((r.doc_id or 0, r.n_tokens) for r in out.collect())
    assert found[:3] == [(0, 0), (1, 0), (1, 0)] and found[3][1] > 80000
    assert token_count.token_counts(df.select("text"), "text", P.path(token_count.VOCABULARY)).count() == 4
    assert token_count.token_counts(df.limit(0), "text", P.path(token_count.VOCABULARY)).count() == 0


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 100, "", "c"])})
    parts = list(balanced(batch.slice(1), "text", 20))
    assert [t for p in parts for t in p.column("text").to_pylist()] == [None, "b" * 100, "", "c"]


def test_ids_are_those_of_the_library():
    texts = strings(4000, 2) + ["", "ab" * 400 + "zq" * 200, " " * 700, "'re" * 300, "\n" * 5]
    codec, enc = byte_bpe.codec(P.path(byte_bpe.VOCABULARY)), reference_bpe()
    ids = codec.encode(*flat(pa.array(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert [codec.decode(x).decode() for x in ids] == texts


def test_scan_does_not_depend_on_blocks():
    codes = np.random.default_rng(3).integers(0, 5, 3000).astype(np.uint8)
    assert (byte_bpe.scan(codes, 7) == byte_bpe.scan(codes, 3000)).all()


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "Hello, wörld's end"), (2, None), (3, ""), (1, "Hello, wörld's end")], "doc_id int, text string").withColumn("ids", F.lit(0))
    path = P.path(byte_bpe.VOCABULARY)
    coded = byte_bpe.encode(df, "doc_id", "text", path)
    whole = byte_bpe.decode(coded, path).collect()
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in whole) == [(1, "Hello, wörld's end")] * 2 + [(2, ""), (3, "")]
    part = byte_bpe.decode(coded.where("doc_id = 1").withColumn("a", F.lit(2)).withColumn("k", F.lit(2)), path, "a", "k").first()
    raw = "Hello, wörld's end".encode()
    assert raw[part.begin:part.begin + len(part.bytes)] == bytes(part.bytes) and len(part.bytes)
    trip = {r.doc_id: r for r in byte_bpe.round_trip(df, ["doc_id"], "text", path).collect()}
    assert trip[1].decoded_sha256 == hashlib.sha256(raw).hexdigest() and trip[2].n_tokens == 0
    assert byte_bpe.round_trip(df.limit(0), ["doc_id"], "text", path).count() == 0


def test_automaton_phrases_are_longest_matches():
    r = random.Random(5)
    learned, text = [r.randint(1, 3) for _ in range(200)], [r.randint(1, 4) for _ in range(150)]
    automaton = language.Automaton(learned, 5)
    inside = {tuple(learned[i:j]) for i in range(200) for j in range(i + 1, 201)}
    phrases, begin = 0, 0
    while begin < len(text):
        end = begin + 1
        while end < len(text) and tuple(text[begin:end + 1]) in inside:
            end += 1
        phrases, begin = phrases + 1, end
    columns = np.array(text, np.int32)[:, None]
    assert automaton.phrases(columns, np.ones(len(text), int)).tolist() == [phrases]


def phrases_by_hand(text, learned):
    count, begin = 0, 0
    while begin < len(text):
        end = begin + 1
        while end < len(text) and text[begin:end + 1] in learned:
            end += 1
        count, begin = count + 1, end
    return count


def test_predictions_by_hand():
    """Whole predictions of short texts, with alphabets of thousands of letters, by substring search."""
    import re
    r = random.Random(11)
    spans = {"aa": (0x61, 26), "bb": (0x430, 32), "cc": (0x4E00, 3000), "dd": (0xAC00, 2000)}
    write = lambda k, n: "".join(chr(spans[k][0] + min(r.randrange(spans[k][1]), r.randrange(spans[k][1]))) + r.choice(["", "", " ", "!  "]) for _ in range(n))
    sample = [(k, write(k, 400)) for k in spans for _ in range(3)] + [("aa", write("bb", 60))]
    parser = language.CrossParser(sample)
    assert sum(a.nbytes() for a in parser.automata) < 3_000_000
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    learned = {k: "".join(plain(t) + " " for kk, t in sample if kk == k) for k in spans}
    texts = [write(r.choice(list(spans)), r.randint(1, 200)) + write(r.choice(list(spans)), r.randint(0, 80)) for _ in range(60)]
    labels, scores = parser.judge(texts)
    for t, label, score in zip(texts, labels, scores.tolist()):
        p = plain(t)
        bits = {k: phrases_by_hand(p, learned[k]) * np.log2(len(learned[k])) / len(p) for k in spans}
        ranked = sorted(bits, key=lambda k: (bits[k], k))
        assert label == ranked[0] and abs(score - (1 - bits[ranked[0]] / bits[ranked[1]])) < 1e-3


def test_language_of_odd_texts(spark):
    sample = [("en", "the cat and the dog ran over the hill and the river "), ("de", "der hund und die katze liefen schnell zur schönen brücke ")]
    rows = [(1, "the dog and the cat"), (2, "die schöne katze"), (3, None), (4, ""), (5, "123 !!"), (6, "the river " * 20000), (1, "the dog and the cat")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit(9)).withColumn("c0", F.lit(1))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, "text", sample).collect()}
    assert [found[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in found.values())
    assert {r.lang_pred for r in language.predict(df, "text", []).collect()} == {"und"}
    assert language.predict(df.limit(0), "text", sample).count() == 0


def test_held_out_accuracy(spark):
    import __spark_entry__ as contract
    folder = "/root/testdata/sf0.01"
    found = contract.queries()["op2_language"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    held = found.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert held.a > 0.97


def test_nothing_is_learned_from_the_held_out_fold(spark):
    rows = [(i, f"text number {i}", "en") for i in range(50)] + [(None, "no id", "en"), (3, None, "en"), (4, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    import zlib
    learned = {t for _, t in language.learn(docs)}
    assert learned == {f"text number {i}" for i in range(50) if zlib.crc32(str(i).encode()) % 5}
