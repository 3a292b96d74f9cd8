"""Encoding against the library, token files against themselves and the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chatlens.llm import bpe, token_files
from chatlens.llm.queries import llm_queries
from chatlens.llm.textbytes import text_bytes
from chatlens.llm.tokens import WordStore

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    pick = random.Random(3)
    plain = "abcdefghijklmnopqrstuvwxyzABC'!?.,;:-_<|>0123 éüñßÀ\n"
    wide = [chr(c) for c in [*range(1, 0x250), 0x300, 0x301, 0x3A3, 0x1F600, 0x4E00, 0x5D0, 0x660, 0xAC00]]
    texts = ["", "  ", "it's we'll I'M 'Sun don't ''s 're!", "½ ² ª º 12345", "<|startoftext|>Hi<|endoftext|> x <|x|>", "ΣΑΣ İ ı", "x" * 500]
    texts += ["".join(pick.choice(plain) for _ in range(pick.randint(0, 60))) for _ in range(800)]
    return texts + ["".join(pick.choice(wide) for _ in range(pick.randint(0, 20))) for _ in range(800)]


@pytest.mark.parametrize("kind", ["trie", "library"])
def test_ids_are_the_librarys(library, kind):
    vocabulary = bpe.Vocabulary(PATH)
    store = WordStore(vocabulary.encode_words, vocabulary.encode_text) if kind == "trie" else token_files.library_store(PATH)
    texts = odd_texts()
    flat, begins = store.ids(*text_bytes(pa.array(texts)))
    for i, (text, found) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        own = flat[begins[i] : begins[i + 1]]
        assert own.tolist() == found.ids, text
        assert vocabulary.decode(own) == library.decode(found.ids, skip_special_tokens=False)


def test_shared_prefixes_are_encoded_once(library):
    vocabulary = bpe.Vocabulary(PATH)
    words = sorted({w.encode() for w in "inter international internationally interned in i".split()})
    together, counts = vocabulary.encode_words(words)
    apart = [vocabulary.encode_words([w])[0].tolist() for w in words]
    assert together.tolist() == sum(apart, []) and counts.tolist() == [len(x) for x in apart]


def test_a_full_store_starts_anew(monkeypatch):
    from chatlens.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    vocabulary = bpe.Vocabulary(PATH)
    store = WordStore(vocabulary.encode_words, vocabulary.encode_text)
    fresh = WordStore(vocabulary.encode_words, vocabulary.encode_text)
    for text in ("a few words", "a few others more", "words again"):
        held = text_bytes(pa.array([text]))
        monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
        mine = store.ids(*held)[0].tolist()
        monkeypatch.setattr(tokens, "KEPT_WORDS", 1000)
        assert mine == fresh.ids(*held)[0].tolist()


def test_odd_documents(spark, library, odd_documents, no_documents):
    encoded = bpe.decode(bpe.encode(odd_documents, PATH), PATH)
    assert set(odd_documents.columns) < set(encoded.columns)
    rows = encoded.collect()
    assert len(rows) == odd_documents.count()
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert bytes(row.ids) == np.array(ids, "<u4").tobytes()
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(bpe.decode(bpe.encode(no_documents, PATH), PATH)).count() == 0


def test_decoding_shares_the_worker_of_encoding(spark):
    rows = [(1, "it's here", "a"), (1, "it's here", "a"), (2, None, None), (None, "x", "b"), (3, "", "c")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _mapped string")
    steps = lambda f: f._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    together = bpe.decode(bpe.encode(frame, PATH), PATH)
    apart = bpe.decode(bpe.encode(frame, PATH).select("*"), PATH)
    assert (steps(together), steps(apart)) == (1, 2)
    order = lambda f: sorted(map(repr, f.collect()))
    assert together.schema == apart.schema and order(together) == order(apart)
    assert steps(corpus_pipeline.tokens_stage(spark, frame, "")) == 1
    assert steps(llm_queries()["op8_bpe"](spark, "/root/testdata/sf0.001")) == 1
    # Other columns than ids come back if asked for; ids and decoded are replaced.
    few = bpe.encode(frame, PATH, keep=["doc_id"])
    assert few.columns == ["doc_id", "ids"] and order(few) == order(together.select("doc_id", "ids"))
    again = bpe.decode(bpe.encode(together, PATH), PATH)
    assert order(again.select(*together.columns)) == order(together)


@pytest.mark.parametrize("top", [1 << 7, 1 << 8, 1 << 16, 1 << 24, (1 << 32) - 1])
def test_packed_numbers_come_back(top):
    numbers = np.random.default_rng(1).integers(0, top, 1003, dtype=np.uint64)
    control, data = token_files.pack(numbers)
    assert len(control) == 251
    assert token_files.unpack(control, data, len(numbers)).tolist() == numbers.tolist()
    assert token_files.unpack(*token_files.pack(numbers[:0]), 0).tolist() == []


def test_files_come_back_in_order(spark, library, odd_documents, no_documents, tmp_path):
    token_files.write_tokens(odd_documents, PATH, str(tmp_path / "odd"), 1)
    found = token_files.read_tokens(spark, str(tmp_path / "odd")).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    given = sorted(
        np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in odd_documents.collect()
    )
    assert sorted(bytes(r.ids) for r in found) == given
    start = 0
    for row in found:
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(row.ids) // 4, zlib.crc32(row.ids))
        start += row.n_tokens
    token_files.write_tokens(no_documents, PATH, str(tmp_path / "none"), 1)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def thue_morse(letters):
    """Two words of 1,024 letters that any polynomial modulo 2^64 takes for one."""
    order = [bin(i).count("1") % 2 for i in range(1 << 10)]
    return "".join(letters[k] for k in order), "".join(letters[1 - k] for k in order)


@pytest.mark.parametrize("kind", ["trie", "library"])
@pytest.mark.parametrize("same", ["by polynomial", "by any hash"])
def test_words_of_one_hash_keep_their_own_ids(library, kind, same, monkeypatch):
    from chatlens.llm import tokens

    if same == "by any hash":
        monkeypatch.setattr(tokens, "hashes", lambda low, starts, ends: np.where(ends - starts > 8, 1, tokens.run_hashes(low, starts, ends)))
    vocabulary = bpe.Vocabulary(PATH)
    for batches in ([[*thue_morse("ab")]], [[w] for w in thue_morse("ab")], [["somewhat longer", "otherwise longest"], ["somewhere elsewhere somewhat"]]):
        token_files._STORES.clear()
        store = WordStore(vocabulary.encode_words, vocabulary.encode_text) if kind == "trie" else token_files.library_store(PATH)
        for texts in batches:
            flat, begins = store.ids(*text_bytes(pa.array(texts)))
            for i, text in enumerate(texts):
                assert flat[begins[i] : begins[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    token_files._STORES.clear()


def test_hashes_of_runs_tell_them_apart():
    from chatlens.llm.textbytes import run_hashes, word_hashes

    pick = random.Random(5)
    words = {bytes(pick.choice(b"abcd") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 1000] for _ in range(60)}
    words = sorted(words | {w.encode() for w in thue_morse("ab")})
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    assert len(set(run_hashes(data, starts, starts + sizes).tolist())) == len(words)
    whole, head = word_hashes(data, starts, starts + sizes, 3)
    assert [len(set(x.tolist())) for x in (whole, head)] == [len(words), len({w[:3] for w in words})]
    assert run_hashes(data[:0], starts[:0], starts[:0]).tolist() == []
