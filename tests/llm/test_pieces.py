"""Piece encoding against the library on whole texts."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shopledger.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  two  spaces ", "Hello, world! It's 3.14 (e.g. x_y²).", "tab\tline\nbreak\r\n\n end",
    "ünïcödé ß € 梦 🙂 ́", "▁mark ▁▁ of its own", "<s> </s> <unk> <0x0A> [INST]", "a" * 5000,
    " " * 70, "x" + " " * 40 + "y", "word " * 4000, "\x00\x01 control", "ends in space ",
    "don't f(x)=y, a->b; c=>d... \"q\" 'r' #s $t %u &v",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n):
    rng = random.Random(9)
    parts = ["the", "ing", "tion", " ", "  ", ".", ",", "!!", "\n", "é", "€", "_", "²", "▁", "Qu", "7", "'"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_one_agenda_is_the_library(library):
    vocabulary = pieces.Vocabulary(PATH)
    for text in TEXTS + random_texts(500):
        assert vocabulary.encode(text) == library.encode(text), repr(text[:60])


def test_words_together_are_words_alone():
    vocabulary = pieces.Vocabulary(PATH)
    rng = random.Random(4)
    letters = "aeiou" * 6 + "tnrsl" * 4 + "ABCdfg.,-7éß梦🙂\x00" + pieces.SPACE
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    words += ["a" * n for n in range(1, 45)] + [pieces.SPACE * n for n in range(1, 45)]
    found = vocabulary.encode_words(words)
    assert found == [vocabulary.encode_escaped(w) for w in words]
    assert vocabulary.encode_words([]) == []


def test_pair_table_is_the_dictionary():
    rng = random.Random(6)
    pairs = {(rng.randint(0, 300), rng.randint(0, 300)): (k, k + 7) for k in range(4000)}
    table = pieces.PairTable(pairs)
    asked = [*pairs, *[(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(4000)]]
    ranks, made = table(*(np.array(side) for side in zip(*asked)))
    for pair, rank, new in zip(asked, ranks.tolist(), made.tolist()):
        assert rank == pairs.get(pair, (pieces.NO_PAIR,))[0]
        assert pair not in pairs or new == pairs[pair][1]


def test_words_are_the_whole_text(library):
    memory = pieces.WordMemory(pieces.Vocabulary(PATH), words=20)
    texts = TEXTS + random_texts(2000)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        assert [list(ids) for ids, _ in memory.encode(part)] == library.encode(part)
    assert all(len(x) < 1000 for x in (memory.words.young, memory.words.old))


def test_remembered_words_are_small():
    rng = random.Random(8)
    memory = pieces.WordMemory(pieces.Vocabulary(PATH))
    texts = [" ".join("".join(rng.choices("aeioutnrslkm", k=7)) for _ in range(200)) for _ in range(300)]
    tracemalloc.start()
    try:
        for _ in memory.encode(texts):
            pass
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    words = len(memory.words.young)
    assert words > 50_000
    assert held < 200 * words
    assert most < 600 * words


def test_rows(spark, library):
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "no id"), (99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    found = pieces.encoded_digests(df, PATH).collect()
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        digests = [",".join(map(str, ids)), library.decode(ids)]
        expected.append((doc_id, len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in digests]))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    ids = {r.doc_id: r.ids for r in pieces.encoded(df, PATH).collect()}
    assert ids[9] == library.encode(TEXTS[9])
    assert pieces.encoded(df.limit(0), PATH).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    model = model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    for change in ("kind", "inside"):
        other = model_pb2.ModelProto()
        other.CopyFrom(model)
        if change == "kind":
            other.trainer_spec.model_type = 1
        else:
            other.pieces[500].piece = "a▁b"
        path = tmp_path / change
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            pieces.Vocabulary(str(path))
