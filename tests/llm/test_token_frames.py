import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs
from tokenizers import Tokenizer

from larder.llm import token_frames as tf
from larder.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def test_words_alone_as_whole_texts():
    r = random.Random(3)
    texts = ["".join(r.choices("aZé'1 \n\t\x0b,ßΣσ\xa0​́Ⅷ①-日本", k=r.randint(0, 60))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tf.Encoder(PATH).encode(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_calls_that_bring_no_new_word():
    for calls in (["123 456"], ["..."], ["word", "word."], ["", " "], ["word word", "word, WORD!", "7"]):
        encoder = tf.Encoder(PATH)
        for text in calls:
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_do_not_depend_on_what_a_worker_met_before():
    r = random.Random(11)
    encoder = tf.Encoder(PATH)
    encoder.encode(["TATİLİ"])
    texts = ["def TATİLİ. yeni", *("".join(r.choices("aZiİIß'1 .,;:!?*\u0307\u0301e\u0338<>Σσǅŉՙ日ﬁ̈", k=r.randint(0, 24))) for _ in range(20_000))]
    got = [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts]
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [(t, x, y) for t, x, y in zip(texts, got, want, strict=True) if x != y] == []


def test_words_are_looked_up_once_a_batch():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)

    encoder = tf.Encoder(PATH)
    encoder.words.now = Counted()
    got = encoder.encode(["word Word, 12 " * 10_000] * 3)
    want = LIBRARY.encode("word Word, 12 ", add_special_tokens=False).ids * 10_000
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want] * 3
    assert Counted.asked < 100


def test_letters_known_from_the_generation_before_are_not_encoded_again(monkeypatch):
    encoder = tf.Encoder(PATH)
    encoder.encode(["alpha straße"])
    encoder.words.held = encoder.words.most + 1
    asked, ids = [], encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda text: asked.append(text) or ids(text))
    got = encoder.encode(["ALPHA; straße?"])[0]
    assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode("ALPHA; straße?", add_special_tokens=False).ids
    assert not any(c.isalpha() for text in asked for c in text.replace("<|startoftext|>", "").replace("<|endoftext|>", ""))


def test_arrow_arrays_in_slices_and_bytes_that_are_no_text():
    texts = ["", " \x0b", "a\tb\x0cc\r\nd\x1ce", "Größe, GRÖSSE!", " ", "x" * 3000, "日本. <|endoftext|>.,", ""]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encoder = tf.Encoder(PATH)
    for array in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array([t.encode() for t in texts])):
        for a in range(len(texts) + 1):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(array.slice(a))] == want[a:]
    with pytest.raises(UnicodeDecodeError):
        tf.Encoder(PATH).encode([b"a \xff"])


def test_tables_of_one_word(spark, table):
    for text in ("123", "...", "word."):
        folder = new_path(spark, "tokens")
        row = tf.summary(tf.read(tf.write(table([(1, text)]), PATH, 1, folder), folder)).collect()
        assert [x.n_tokens for x in row] == [len(LIBRARY.encode(text, add_special_tokens=False).ids) + 1]


def test_files(spark, table):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["alpha", "Beta", "γ", "12"], k=r.randint(0, 50)))) for i in r.sample(range(1000), 200)] + [(None, "no id"), (7000, None), (7001, ""), (7002, "x " * 20_000), (7003, "twice"), (7003, "twice")]
    folder = new_path(spark, "tokens")
    manifest = tf.write(table(rows), PATH, 1, folder)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    want, start = [], 0
    for i, t in ordered:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(x) for x in tf.summary(tf.read(manifest, folder)).collect()]
    assert sorted(got, key=lambda x: x[1]) == want

    store, base = fs.FileSystem.from_uri(folder)
    file = max(manifest.collect(), key=lambda x: x.docs).file
    with store.open_input_file(f"{base}/{file}") as source:
        reader = tf.Reader(source)
        i = int(reader.ids[5])
        assert reader.find(i)[0].tolist() == [*LIBRARY.encode(dict(rows)[i] or "", add_special_tokens=False).ids, 1]
        assert reader.find(-5) == []
        source.seek(0)
        whole = source.read()
    # Any zstandard reader takes the frames one after another and skips the tables.
    plain = zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert plain == b"".join(reader_bytes(whole))
    damaged = bytearray(whole)
    damaged[12] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(reader_bytes(bytes(damaged)))


class Held:
    def __init__(self, data):
        self.data, self.pos = data, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.pos = at

    def read(self, n):
        return self.data[self.pos : self.pos + n]


def reader_bytes(data):
    r = tf.Reader(Held(data))
    for i in range(len(r)):
        yield r.document(i).tobytes()


def test_empty(spark, table):
    folder = new_path(spark, "tokens")
    assert tf.read(tf.write(table([]), PATH, 1, folder), folder).count() == 0


def test_special_strings_as_an_untouched_library():
    own = Tokenizer.from_file(PATH)
    r = random.Random(5)
    parts = ["hello", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "a<|endoftext|>b", " ", "\n", "World's", "<|STARTOFTEXT|>", "e", "́", "Å", "\x1c", "\x85"]
    texts = ["hello <|startoftext|> world", "<|endoftext|>", *("".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(500))]
    assert [np.frombuffer(x, "<u4").tolist() for x in tf.Encoder(PATH).encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(tf.Encoder(PATH).encode(texts)[0], "<u4").tolist() == [3306, 49406, 1002]
