"""BPE encoding and decoding by tree concatenation.

A text longer than ``leaf_chars`` is halved again and again; the leaves are
encoded on their own and then joined pairwise up the tree.  At a join, a window
of tokens around the seam is encoded anew and grows until its first and last
token are the ones that the two sides already had there.  Byte-pair encoding
makes that exact: a sequence of tokens is the encoding of its bytes if each pair
of neighbours is the encoding of that pair's bytes, and the pre-tokeniser reads
left to right with no memory, so that agreement at both ends of the window fixes
everything outside it.

Texts of any length, also ones with no white space, thus cost time in proportion
to their length and bounded extra memory; all other texts are one leaf.

Cases: a null text counts as empty (no ids, digest of no bytes); repeated rows
and repeated ids give a row each; an empty table gives no rows; other columns of
the input, whatever their names, are not read by :func:`encode`.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import rows_of

#: Fixed value: the split pattern of byte-level BPE as the tokenizers library has it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 16_384
FIRST_WINDOW = 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (pre["type"], pre.get("add_prefix_space"), spec["normalizer"]) != ("ByteLevel", False, None):
            raise ValueError("only byte-level vocabularies without prefix space and normalizer are supported")
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in word): i for word, i in model["vocab"].items()}
        for i, pair in enumerate(model["merges"]):  # ids must rise with the merges, so that an id is a rank
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][left + right] != 256 + i:
                raise ValueError("the vocabulary's ids do not follow its merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {k: v for k, v in ranks.items() if v not in self.special.values()}
        self.encoder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)
        self.leaf_chars = leaf_chars
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.length = np.zeros(size, np.int64)
        for word, i in ranks.items():
            self.length[i] = len(word)
        for word, i in self.special.items():
            self.length[i] = len(word.encode())

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self.encoder.encode(text, allowed_special="all", disallowed_special=()), dtype=np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if len(text) <= self.leaf_chars:
            return self.direct(text)
        parts = []
        for piece in self._without_special(text):
            parts.append(np.array([piece], np.uint32) if isinstance(piece, int) else self._tree(piece))
        return np.concatenate(parts)

    def _without_special(self, text: str):
        """The text cut at special tokens, as a leaf edge must not fall inside one."""
        at = 0
        while True:
            found = [(text.find(s, at), -len(s), s) for s in self.special if text.find(s, at) >= 0]
            if not found:
                break
            start, _, s = min(found)
            if start > at:
                yield text[at:start]
            yield self.special[s]
            at = start + len(s)
        if at < len(text):
            yield text[at:]

    def _tree(self, text: str) -> np.ndarray:
        """Leaves first, then joins level by level (no recursion, so any depth)."""
        level = [text]
        while len(level[0]) > self.leaf_chars or len(level[-1]) > self.leaf_chars:
            level = [h for t in level for h in ((t[: len(t) // 2], t[len(t) // 2 :]) if len(t) > 1 else (t,))]
        nodes = [(np.asarray(ids, np.uint32), t.encode()) for ids, t in zip(self.encoder.encode_ordinary_batch(level, num_threads=2), level, strict=True)]
        while len(nodes) > 1:
            nodes = [self._join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0][0]

    def _join(self, a: tuple[np.ndarray, bytes], b: tuple[np.ndarray, bytes]) -> tuple[np.ndarray, bytes]:
        (left, lb), (right, rb) = a, b
        whole = lb + rb
        reach = FIRST_WINDOW
        while True:
            i, start = self._edge_left(left, lb, reach)
            j, end = self._edge_right(right, rb, reach)
            window = np.asarray(self.encoder.encode_ordinary((lb[start:] + rb[:end]).decode()), np.uint32)
            from_left = i == 0 or (len(window) > 1 and window[0] == left[i])
            from_right = j == len(right) or (len(window) > 1 and window[-1] == right[j - 1])
            if from_left and from_right:
                return np.concatenate([left[:i], window, right[j:]]), whole
            reach *= 2

    def _edge_left(self, ids: np.ndarray, text: bytes, reach: int) -> tuple[int, int]:
        """(first token of the window, its byte offset): ``reach`` tokens back at least, at a character's start."""
        i = max(0, len(ids) - reach)
        start = len(text) - int(self.length[ids[i:]].sum())
        while i and (text[start] & 0xC0) == 0x80:
            i -= 1
            start -= int(self.length[ids[i]])
        return i, start

    def _edge_right(self, ids: np.ndarray, text: bytes, reach: int) -> tuple[int, int]:
        """(one past the window's last token, its end offset), at a character's end."""
        j = min(len(ids), reach)
        end = int(self.length[ids[:j]].sum())
        while j < len(ids) and (text[end] & 0xC0) == 0x80:
            end += int(self.length[ids[j]])
            j += 1
        return j, end

    def decode(self, ids: np.ndarray) -> str:
        return self.encoder.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    return Codec(path, leaf_chars)


def vocabulary_path() -> str:
    """The default vocabulary, a file that ships with the machine's Python."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(text: Column, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> Column:
    """Token ids (array of int) of a text column."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batch: pa.Array) -> pa.Array:
        c = codec(path or vocabulary_path(), leaf_chars)
        return pa.array([c.encode(t).astype(np.int32) for t in batch.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a column of token ids; a null list counts as empty."""

    @F.arrow_udf(T.StringType())
    def text(batch: pa.Array) -> pa.Array:
        c = codec(path or vocabulary_path())
        return pa.array([c.decode(np.asarray(x or [], np.uint32)) for x in batch.to_pylist()], pa.string())

    return text(ids)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode, decode and digest each text in one pass over the rows; no shuffle."""

    def digests(batches):
        c = codec(path or vocabulary_path(), leaf_chars)
        for batch in batches:
            for part in rows_of(batch):
                out = []
                for text in part.column(1).to_pylist():
                    ids = c.encode(text)
                    out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
                n, a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digests, DIGEST)
