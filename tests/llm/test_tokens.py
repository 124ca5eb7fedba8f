"""Token counts, pieces and packing against the tokenizers' own libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from conftest import FOLDER
from corpus import AWKWARD, documents, rows_of, words

from pursebook.llm import packing, queries
from pursebook.llm.packing import ChunkIds, Document, Index, pack_rest, pack_shard, packed_sequences
from pursebook.llm.pieces import Encoder, encoded_pieces
from pursebook.llm.token_counts import Counter as TokenCounter
from pursebook.llm.token_counts import token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def strange(count=1500):
    rng = random.Random(3)
    characters = "ab  \n\t'.,!1é▁ß漢　 ​ \x85\xa0\x1ć\0Σİ🙂"
    made = ["".join(rng.choice(characters) for _ in range(rng.randint(1, 40))) for _ in range(count)]
    return made + ["", " ", "\n", "  a", "a  ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<s>x</s>", "<unk>", "I'm you'll 'S", "x" * 3000]


def test_counts_of_strange_texts():
    library, own = Tokenizer.from_file(BYTES), TokenCounter(BYTES)
    some = strange()
    assert [own.count(t) for t in some] == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_token_counts(table):
    library = Tokenizer.from_file(BYTES)
    found = token_counts(documents(table, AWKWARD))
    expected = []
    for doc_id, text in AWKWARD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 512))
    assert rows_of(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=str)
    assert token_counts(documents(table, [])).collect() == []


def test_token_counts_of_the_table(spark):
    library = Tokenizer.from_file(BYTES)
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op8_token_counts(spark, FOLDER).collect()}
    assert found == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in given}


def test_pieces_of_strange_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), Encoder(PIECES)
    some = strange()
    encoded, differing = own.encode(some)
    assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == library.encode(some, add_bos=True, add_eos=True)
    assert differing == 0


def test_pieces(table):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = []
    for doc_id, text in AWKWARD:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids)
        raw = np.array(ids, "<u4").tobytes()
        expected.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded))
    found = encoded_pieces(documents(table, AWKWARD), with_ids=True)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded") == sorted(expected, key=str)
    assert encoded_pieces(documents(table, [])).collect() == []


def test_both_agendas_agree_with_the_library():
    encoder = Encoder(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(12)
    for _ in range(2000):
        word = "▁" + "".join(rng.choice("aaabehinorstuéßж漢🙂") for _ in range(rng.randint(0, 40)))
        flat, heap = encoder._merged_flat(word), encoder._merged(word)
        assert flat == heap and "".join(flat) == word
        assert word == "▁" or encoder.word(word) == encoder.library.encode(word[1:])


def test_pieces_make_the_round_trip(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = queries.op7_sentence_pieces(spark, FOLDER).join(given, "doc_id")
    assert found.where("decoded_sha256 <> sha2(text, 256)").count() == 0
    assert found.where("n_differing > 0").count() == 0


def check_packing(rows, found):
    """Each id lies in one piece, pieces follow each other without gaps, and sequences are full or a power of two."""
    library = Tokenizer.from_file(WORDS)
    ids = [(doc_id, np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")) for doc_id, text in rows]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert Counter(r["doc_id"] for r in found).keys() == dict(ids).keys()
    if len(dict(ids)) == len(ids):
        for doc_id, own in ids:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
                assert (r["start"], r["doc_tokens"]) == (at, len(own))
                assert r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(own)
    assert sum(r["length"] for r in found) == sum(len(own) for _, own in ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(table):
    rows = AWKWARD[:4] + AWKWARD[5:13] + AWKWARD[15:]
    check_packing(rows, packed_sequences(documents(table, rows)).collect())
    assert packed_sequences(documents(table, [])).collect() == []


def test_packing_of_repeated_and_unnamed_rows(table):
    check_packing(AWKWARD, packed_sequences(documents(table, AWKWARD), shard_tokens=500).collect())


def test_packing_of_the_table(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(given, queries.op4_retrieval_packing(spark, FOLDER).collect())


def test_a_seed_meets_its_likes():
    """Documents of two vocabularies: windows hold documents of one."""
    rng = np.random.default_rng(1)
    kinds = [np.arange(0, 400), np.arange(400, 800)]
    shard = [Document(i, rng.choice(kinds[i % 2], 100).astype(np.uint32)) for i in range(60)]
    windows = list(pack_shard(shard, 1000))
    assert sum(len({d.doc_id % 2 for d, _, _ in window}) == 1 for window in windows) >= len(windows) - 2
    rest = list(pack_rest(shard, 1000))
    assert sum(length for pieces in windows + rest for _, _, length in pieces) == 6000


def test_scores_are_those_of_the_formula():
    shard = [Document(i, np.array(ids, np.uint32)) for i, ids in enumerate([[5, 5, 9], [5, 7], [8], [9, 9, 9, 7], [3], [2]])]
    scores = Index(shard).scores(0)
    mean = np.mean([d.left for d in shard])
    for j, other in enumerate(shard):
        expected = 0.0
        for term in {5, 9}:
            holders = sum(term in d.ids for d in shard)
            idf = max(np.log((6 - holders + 0.5) / (holders + 0.5)), 0)
            count = (other.ids == term).sum()
            expected += idf * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * other.left / mean))
        assert abs(scores[j] - expected) < 1e-5


def test_ids_of_words_are_the_library_s():
    library, own = Tokenizer.from_file(WORDS), ChunkIds(WORDS)
    some = strange() + ["Don't. A'S! İ. İstanbul... H̱, Ǩ× ÷. <|ENDOFTEXT|> <|endoftext|>. é. é. ǅ; 12ab34,,5 ŉ:s a#'t it's?'s"]
    for given in (some, [t.upper() for t in some], some):
        assert [ids.tolist() for ids in own.of([t.encode() for t in given])] == [e.ids for e in library.encode_batch(given, add_special_tokens=False)]


def test_few_remembered_words_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 5)
    test_ids_of_words_are_the_library_s()


def likes(count=400):
    """Pairs of documents with words of their own, the two far from each other, in noise that all share."""
    noise = words(5, 60).split()
    rng = random.Random(6)
    own = [words(100 + i, 12) for i in range(count)]
    return [(side * count + i, " ".join([*rng.sample(noise, 30), own[i]])) for side in (0, 1) for i in range(count)]


def met(found, count=400):
    """Share of the pairs that lie in a common window."""
    windows = defaultdict(set)
    for r in found:
        windows[r["doc_id"]].add(r["sequence_id"])
    return sum(bool(windows[i] & windows[count + i]) for i in range(count)) / count


def test_likes_meet_whatever_the_partitions(table):
    rows = likes()
    one, many = (packed_sequences(documents(table, rows).repartition(n), shard_tokens=10_000).collect() for n in (1, 64))
    check_packing(rows, many)
    assert {tuple(r) for r in one} == {tuple(r) for r in many}
    assert met(one) == met(many) >= 0.8
