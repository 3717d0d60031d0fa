"""BPE encoding and decoding by a table of distinct words.

Texts are split into the words that the tokenizer's own normalizer and pre-tokenizer make; each
distinct word is encoded once by the tokenizer; the ids are joined back to every document by the
word's position. Decoding looks up each id's piece in the table of pieces, whose size is the
vocabulary's, and joins them as the library does for a tokenizer without a decoder.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .blocks import block_docs, block_words, documents, pack, shard_count, unpack, unpack_words
from .common import materialize, pin_splits, texts, tidy

VOCABULARY = "word_bpe_49k.json"
#: Texts of characters below this (whose lower case is below it too, but for one mark) are split by Python's re; their classes don't differ between Unicode versions.
LATIN = 0x180


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@cache
def splitter(path: str) -> Callable[[str], list[str]]:
    """A function from a text to its words, as the tokenizer at ``path`` splits it.

    A special token's text in a document is a word of its own, as the library has it.
    """
    import json

    from tokenizers import Regex, pre_tokenizers

    tok = _tokenizer(path)
    with open(path, encoding="utf-8") as f:
        pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    split, normal = pre_tokenizers.Split(Regex(pattern), "removed", invert=True), tok.normalizer
    special = re.compile("(" + "|".join(re.escape(x.content) for x in tok.get_added_tokens_decoder().values()) + ")")
    chars = [chr(k) for k in range(LATIN)]
    kinds = {k: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k) for k in "LN"}
    blank = "\\t-\\r \\x85\\xa0"
    letters = r"[\p{L}]+"
    ahead = f"{letters}|" + "".join(x + "|" for x in pattern.split("|") if x != letters)  # nothing else begins with a letter
    plain = re.compile(ahead.rstrip("|").replace(r"[\p{L}]", f"[{kinds['L']}]").replace(r"[\p{N}]", f"[{kinds['N']}]").replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{kinds['L']}{kinds['N']}]")).findall
    exotic = re.compile(f"[^\\x00-{chr(LATIN - 1)}]").search

    def words(text: str) -> list[str]:
        if "<|" in text and special.search(text):
            return [w for part in special.split(text) for w in ([part] if special.fullmatch(part) else words(part))]
        if text.isascii() or not exotic(text):
            return plain(text.lower())
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    return words


def word_ids(listed: DataFrame, path: str) -> DataFrame:
    """(block, places, ids, counts): for each block, its words' ids end to end, and how many each has.

    All rows of a word are in one shard, and a task keeps what it has encoded of a shard, so each
    distinct word is encoded once.
    """

    def encode(frames):
        import pyarrow as pa

        tok, known, current = _tokenizer(path), {}, None
        for frame in frames:
            for k in range(frame.num_rows):
                shard = frame.column("shard")[k].as_py()
                if shard != current:
                    known, current = {}, shard
                words = unpack_words(frame.column("words")[k].as_py())
                new = [w for w in words if w not in known]
                for w, x in zip(new, tok.encode_batch(new, add_special_tokens=False), strict=True):
                    known[w] = x.ids
                own = [known[w] for w in words]
                ids, counts = np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.uint32)
                yield pa.RecordBatch.from_arrays([frame.column("block").slice(k, 1), frame.column("places").slice(k, 1), pa.array([pack(ids)]), pa.array([pack(counts)])], ["block", "places", "ids", "counts"])

    dealt = listed.select("shard", "block", "places", "words").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(tidy(encode), "block long, places binary, ids binary, counts binary")


def pieces(path: str) -> list[str]:
    """The text of each id."""
    tok = _tokenizer(path)
    found = tok.get_vocab(with_added_tokens=True)
    out = [""] * (max(found.values()) + 1)
    for piece, k in found.items():
        out[k] = piece
    return out


def encode(docs: DataFrame, path: str | None = None, written: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    ``written``: docs is a scan of files, which need not be written again to be read twice alike.
    A null text counts as empty; an empty text has no tokens and the hashes of the empty string.
    Repeated rows each give a row.
    """
    pin_splits(docs.sparkSession)
    path = path or vocabulary_path()
    docs = texts(docs) if written else materialize(texts(docs))

    def split(text):
        return splitter(path)(text)

    known = word_ids(block_words(docs, split, shard_count(docs)), path)

    def resolve(left, right):
        import pyarrow as pa

        names, places, own, counts = [x.encode() for x in pieces(path)], [], [], []
        for k in range(right.num_rows):
            n = unpack(right.column("counts")[k].as_py())
            places.append(unpack(right.column("places")[k].as_py()))
            counts.append(n)
            own += [x.tolist() for x in np.split(unpack(right.column("ids")[k].as_py()), np.cumsum(n)[:-1])]
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        size = np.zeros(len(places), np.int64)
        size[places] = np.concatenate(counts) if counts else 0
        ids, decoded = [b""] * len(places), [b""] * len(places)
        for place, x in zip(places.tolist(), own, strict=True):
            ids[place], decoded[place] = b" ".join([b"%d" % i for i in x]), b" ".join([names[i] for i in x])
        counts = size
        gone = not counts.all()
        rows = []
        for doc_id, _, places in documents(left):
            if gone:
                places = places[counts[places] > 0]
            at = places.tolist()
            rows.append((doc_id, int(counts[places].sum()), sha256(b" ".join(map(ids.__getitem__, at))).hexdigest(), sha256(b" ".join(map(decoded.__getitem__, at))).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = block_docs(docs, split)
    return own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(resolve, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
