"""Encoding, spans and counts against the sentencepiece library itself."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as schema

from noteframe.llm import pieces, sentence_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = list("aabbeth   .,\n\t▁é漢𐍈0'！ﬁ①Ａ²  ß") + ["the", "ing ", "  ", "́", "é", "​"]


def texts(count=1500, seed=3):
    rnd = random.Random(seed)
    some = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(count)]
    return [*some, "", " ", "   ", "\n", "▁", "a" * 3000, "word " * 2000]


def proto():
    out = schema.ModelProto()
    with open(PATH, "rb") as file:
        out.ParseFromString(file.read())
    return out


def compiled_map(pairs):
    """A compiled character map: double-array trie of the keys, then the replacements."""
    strings, trie = b"", {}
    for key, new in pairs.items():
        node = trie
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[0] = len(strings)
        strings += new.encode() + b"\0"
    units, used = {}, {0}

    def place(node, at):
        labels = sorted(k for k in node)
        base = at ^ 1
        while any((base ^ b) in used for b in labels) or (at ^ base) >= 1 << 21:
            base += 1
        for b in labels:
            used.add(base ^ b)
        units[at] = units.get(at, 0) | (at ^ base) << 10 | (256 if 0 in node else 0)
        for b in labels:
            if b:
                units[base ^ b] = units.get(base ^ b, 0) | b
                place(node[b], base ^ b)
            else:
                units[base] = node[0] | 1 << 31

    place(trie, 0)
    size = (max(units) // 256 + 1) * 256
    blob = struct.pack(f"<{size}I", *[units.get(k, 0) for k in range(size)])
    return struct.pack("<I", len(blob)) + blob + strings


MAP = {"ﬁ": "fi", "①": "1", "Ａ": "A", "²": "2", "！": "!", "　": " ", "\t": " ", "\n": " ", "é": "é", "​": "", "ß": "ss"}


def variants(tmp_path):
    """Models with each kind of normaliser, with and without byte fallback."""
    out = [PATH]
    for k, (squeeze, dummy, fallback) in enumerate([(True, True, True), (True, False, False), (False, True, False)]):
        model = proto()
        rules = model.normalizer_spec
        rules.precompiled_charsmap = compiled_map(MAP)
        rules.remove_extra_whitespaces, rules.add_dummy_prefix = squeeze, dummy
        model.trainer_spec.byte_fallback = fallback
        if not fallback:
            for piece in model.pieces:
                if piece.type == pieces.BYTE:
                    piece.type = pieces.NORMAL
                    piece.score = -1e6
        path = tmp_path / f"variant{k}.model"
        path.write_bytes(model.SerializeToString())
        out.append(str(path))
    return out


def test_ids_equal_the_library(tmp_path):
    given = texts()
    for path in variants(tmp_path):
        model = pieces.PieceModel(path)
        ids, start, end, at = sentence_pieces.encode(model, pieces.UnitTable(sentence_pieces._solver(model)), given)
        want = model.library.encode(given, num_threads=1)
        got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        odd = [(t, g, w) for t, g, w in zip(given, got, want) if g != w]
        assert not odd, (path, odd[:2])
        assert (start <= end).all()


def test_spans_cover_the_text_in_order():
    model = pieces.load(PATH)
    given = texts(300)
    ids, start, end, at = sentence_pieces.encode(model, pieces.UnitTable(sentence_pieces._solver(model)), given)
    for k, text in enumerate(given):
        raw, a, b = text.encode(), at[k], at[k + 1]
        covered = b""
        for i in range(a, b):
            if i > a and (start[i], end[i]) == (start[i - 1], end[i - 1]) and model.kinds[ids[i]] == pieces.BYTE:
                continue
            covered += raw[start[i] : end[i]]
        assert covered == raw
        plain = [i for i in range(a, b) if model.kinds[ids[i]] == pieces.NORMAL and end[i] > start[i]]
        for i in plain:
            shown = model.library.id_to_piece(int(ids[i])).replace("▁", " ")
            assert raw[start[i] : end[i]].decode().replace("▁", " ") == (shown if i > a else shown[1:] or shown)


def test_spans_follow_the_character_map(tmp_path):
    model = pieces.PieceModel(variants(tmp_path)[1])
    norm, start, end = model.normalise("xﬁ é")
    assert norm == "▁xfi▁é"
    assert list(zip(start.tolist(), end.tolist())) == [(0, 0), (0, 1), (1, 4), (1, 4), (4, 5), (5, 8)]


def test_longest_key_wins():
    table = pieces.CharacterMap(compiled_map({"a": "1", "ab": "2", "abc": "3"}))
    assert table.longest(b"abd", 0) == (2, "2") and table.longest(b"xabc", 1) == (3, "3") and table.longest(b"b", 0) is None


def test_query_digests_and_round_trip(spark):
    rows = [(1, "Hello  world\n", "x"), (2, None, None), (None, "déjà vu 🎈", "y"), (1, "Hello  world\n", "x"), (4, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = sentence_pieces.encoded(docs, PATH)
    got = sorted((r.doc_id or 0, r.decoded, len(r.ids)) for r in coded.collect())
    assert [g[1] for g in got] == ["déjà vu 🎈", "Hello  world\n", "Hello  world\n", "", ""]
    assert sentence_pieces.digests(coded).where("doc_id = 2").first().n_tokens == 0
    assert sentence_pieces.encoded(docs.limit(0), PATH).collect() == []


def unigram_model(tmp_path):
    """The vocabulary as a unigram model; the placeholder scores of blank runs are made ordinary."""
    model = proto()
    model.trainer_spec.model_type = 1
    low = min(p.score for p in model.pieces if p.type == pieces.NORMAL and p.score > -1e8)
    for piece in model.pieces:
        piece.score = max(piece.score, low - 100) if piece.type == pieces.NORMAL else piece.score
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_counts_equal_the_library(tmp_path):
    given = texts()
    path = unigram_model(tmp_path)
    model = pieces.PieceModel(path)
    tokens, _ = token_counts.count(model, token_counts.counter(model), given)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [len(x) for x in library.encode(given, num_threads=1)]
    assert tokens.tolist() == want


def test_trie_sharing_changes_nothing():
    model = pieces.load(PATH)
    units = sorted({"▁" + "".join(random.Random(k).choice("abcthe") for _ in range(k % 9)) for k in range(400)})
    alone = [token_counts.trie_counts(model, [u])[0] for u in units]
    assert token_counts.trie_counts(model, units) == alone


def test_token_count_rows(spark):
    rows = [(1, "Hello world"), (None, None), (1, "Hello world"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs, PATH).collect())
    assert got[0] == (0, 0, 0) and got[1] == got[2] and got[1][2] > 0 and got[3] == (2, 0, 0)


def test_unit_table_survives_being_cleared(monkeypatch):
    model = pieces.load(PATH)
    table = pieces.UnitTable(sentence_pieces._solver(model))
    monkeypatch.setattr(pieces.UnitTable, "MOST", 3)
    for text in ("one two three four five six", "seven eight nine", "one two three"):
        ids, *_ = sentence_pieces.encode(model, table, [text])
        assert ids.tolist() == model.library.encode(text)
    assert isinstance(ids, np.ndarray)
