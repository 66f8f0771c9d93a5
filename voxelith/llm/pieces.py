"""SentencePiece encoding and decoding by a forward pass over a trie of distinct marked words.

The public vocabulary is BPE, whose encoding is not the path of the highest sum of scores, so a Viterbi pass over scores
would give other ids than the library. What takes the place of the best score here follows from the merges themselves.
Merges of a BPE vocabulary never cross a boundary between two pieces whose joined text splits into just these two. So
the encoding of every prefix ends in one piece only: the one that stands after the encoding of a shorter prefix and
splits cleanly from that one's last piece. The forward pass keeps this last piece for each prefix. Words are sorted and
walked depth-first as a trie: what two neighbours have in common keeps its forward states, and only the rest is passed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .known import MUCH, Known

MARK = "▁"
#: Letters and signs between which words may be cut, if the vocabulary joins them in no piece.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pairs of neighbouring pieces that a worker remembers; it starts anew beyond that. Texts that are encoded at once.
PAIRS, TEXTS = 400_000, 512


class Pieces:
    """Encoder and decoder of a BPE vocabulary with byte fallback, a leading mark and no other normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        whole = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in whole}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.rank = {self.text[i]: sp.get_score(i) for i in whole}
        self.ending: dict[str, int] = {}  # by last two characters: length of the longest piece that ends so
        for p in self.id:
            self.ending[p[-2:]] = max(len(p), self.ending.get(p[-2:], 0))
        self.bytes = [bytes([self.of_byte[i]]) if i in self.of_byte else self.text[i].encode() for i in range(n)]
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.id)  # no piece has a mark after a letter
        pairs = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        joined = {p[0] for p in pairs if p[1] in SIGNS}
        letters = re.escape("".join(c for c in LETTERS if c not in joined))
        # No piece holds such a letter and a sign after it, so no merge crosses the cut between them.
        self.word = re.compile(f"{MARK}*+[^{MARK}{letters}]*+[{letters}]++(?=[{re.escape(SIGNS)}])|{MARK}*[^{MARK}]+|{MARK}+" if letters else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.clean: dict[tuple[str, str], bool] = {}
        self.known = Known(MUCH)

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first, until none is left: for short texts."""
        parts, rank, none = list(text), self.rank.get, -np.inf
        joins = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while joins and (best := max(joins)) > none:
            i = joins.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i:
                joins[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(joins):
                joins[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces' joined text splits into just these two."""
        if len(self.clean) > PAIRS:
            self.clean.clear()
        ok = self.clean[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def ids(self, parts: Iterable[str]) -> bytes:
        get, byte = self.packed.get, self.byte
        return b"".join(get(p) or b"".join(byte[b].to_bytes(4, "little") for b in p.encode("utf-8", "replace")) for p in parts)

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, by one depth-first walk over their trie.

        ``last[j]`` is the last piece of the encoding of the first j letters: the longest piece there that splits cleanly
        from the last piece before it.
        """
        out, before, last = {}, "", [""]
        clean, pieces, longest, packed, fits = self.clean.get, self.id, self.ending.get, self.packed, self.fits
        for w in sorted(words):
            same, size = 0, len(w)
            if w[:1] == before[:1]:
                most = min(size, len(before))
                while same < most and w[same] == before[same]:
                    same += 1
            del last[same + 1:]
            for j in range(same + 1, size + 1):
                n = longest(w[j - 2:j], 1) if j > 1 else 1
                if n > j:
                    n = j
                while n > 1:
                    p = w[j - n:j]
                    if p in pieces:
                        ok = clean((last[j - n], p))
                        if ok or ok is None and fits(last[j - n], p):
                            break
                    n -= 1
                last.append(p if n > 1 else w[j - 1])
            parts, j = [], size
            while j:
                p = last[j]
                parts.append(p)
                j -= len(p)
            parts.reverse()
            try:
                out[w] = b"".join([packed[p] for p in parts])
            except KeyError:  # a letter without a piece goes as its bytes
                out[w] = self.ids(parts)
            before = w
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts. Words of more than 64 letters are not remembered; what is remembered has a bound in bytes."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        split = [self.word.findall(m) if self.apart else [m] * bool(m) for m in marked]
        self.known.begin()
        new = self.known.missing(set().union(*split))
        self.known.learn(self.learn(new))
        get = self.known.young.__getitem__
        out = [np.frombuffer(b"".join(map(get, ws)), "<u4") for ws in split]
        self.known.forget(new)
        return out

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out.decode("utf-8", "replace").replace(MARK, " ")[1:]


def vocabulary(path: str) -> Pieces:
    """One per worker process and file."""
    return scratch.loaded(("pieces", path), lambda: Pieces(path))


def encode(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text; further columns are ignored) and decode it again.

    Returns doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), round_trip (the decoded text equals the
    text), and with ``ids`` the ids. Null and empty texts have no id; texts of any length are encoded whole. Texts that hold the mark itself decode to blanks
    there, and then round_trip is false. Repeated rows are each encoded; an empty table gives an empty table.
    """
    schema = "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean" + ", ids array<int>" * ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            for at in range(0, len(b), TEXTS):
                part = b.iloc[at:at + TEXTS]
                found = v.encode(part["text"].tolist())
                out = pd.DataFrame({"doc_id": part["doc_id"].array, "n_ids": [len(x) for x in found], "ids_crc32": [zlib.crc32(x.tobytes()) for x in found], "round_trip": [v.decode(x.tolist()) == (t or "") for x, t in zip(found, part["text"], strict=True)]})
                if ids:
                    out["ids"] = [x.astype(np.int32) for x in found]
                yield out

    return scratch.lean(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scratch.tidy(run, ("pieces", path)), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, repeated rows are each decoded, none gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "text": [None if x is None else v.decode(list(map(int, x))) for x in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(scratch.tidy(run, ("pieces", path)), "doc_id bigint, text string")
