"""Byte-level BPE by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over *tokens* whose accepted
strings are exactly the tokenizations that BPE produces. A state stands for the token read
last. The automaton starts with one state per byte and every arc present. The gadget of the
merge ``u v -> w`` then

* adds the state ``w``; whoever could reach ``u`` at that time can reach ``w``,
* gives ``w`` the arcs that leave ``v`` at that time,
* removes the arc from ``u`` to ``v`` (and, where ``u`` is ``v``, the arc from ``u`` to ``w``,
  since runs merge from the left).

Copying rows and columns of a 50,000 x 50,000 arc table would take gigabytes, so a gadget keeps
them by reference (which state it copied, and when); an arc is looked up by following those
references and is then kept in a table. Encoding a pre-split word walks the byte trie of the arc
labels and takes arcs that the state before allows, which the automaton makes unique for the
whole word. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from array import array
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import kept, map_batches

#: Fixed: how the byte-level scheme splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of code points below 256, where plain character classes suffice.
_LETTER, _NUMBER, _SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
SPLIT_LATIN1 = rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenAutomaton:
    """Tables compiled from merges; ``encode_word`` and ``decode`` use nothing else."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        symbols = byte_symbols()
        size = max([*vocab.values(), *(special or {}).values()], default=-1) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if all(c in symbols for c in token):
                self.labels[i] = bytes(symbols[c] for c in token)
        self.special = dict(special or {})
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        self.of_byte = [vocab.get(c, -1) for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        # One entry per gadget: when it was added, and whose row and column it copied.
        self.born = array("l", [0]) * size
        self.row_of = array("l", range(size))
        self.column_of = array("l", range(size))
        self.removed: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        #: Byte trie of the arc labels: a node maps a byte to (the arc that ends there or -1, the next node).
        self.trie: dict[int, tuple] = {}
        for i in self.of_byte:
            if i >= 0:
                self._add_label(i)
        for time, (left, right) in enumerate(merges, 1):
            self._add_gadget(time, vocab[left], vocab[right], vocab[left + right])
        self.length = [len(x) for x in self.labels]
        self.shorter = [self._longest(x[:-1], 0) if x else -1 for x in self.labels]

    def _add_gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.removed.setdefault(u << 32 | v, time)
        if self.born[w] == 0 and self.row_of[w] == w:
            self.born[w], self.row_of[w], self.column_of[w] = time, v, u
            self._add_label(w)

    def _add_label(self, token: int) -> None:
        node, label = self.trie, self.labels[token]
        for b in label[:-1]:
            node = node.setdefault(b, (-1, {}))[1]
        node[label[-1]] = (token, node.get(label[-1], (-1, {}))[1])

    def _longest(self, word: bytes, at: int) -> int:
        """The longest arc label that ``word`` has at ``at``."""
        node, best = self.trie, -1
        while at < len(word) and (hit := node.get(word[at])):
            token, node = hit
            if token >= 0:
                best = token
            at += 1
        return best

    def has_arc(self, p: int, q: int) -> bool:
        """Whether token ``q`` may follow token ``p``."""
        found = self.arcs.get(p << 32 | q)
        if found is None:
            if len(self.arcs) > 250_000:
                self.arcs.clear()
            found = self.arcs[p << 32 | q] = self._follow(p, q)
        return found

    def _follow(self, p: int, q: int) -> bool:
        now = 1 << 60
        while True:
            gone = self.removed.get(p << 32 | q)
            if gone is not None and gone < now:
                return False
            born_p, born_q = self.born[p], self.born[q]
            if not born_p and not born_q:
                return True
            if born_q > born_p:
                now, u = born_q, self.column_of[q]
                if p == u and self.row_of[q] == u:  # u, uu: the run would have merged from the left
                    return False
                q = u
            elif born_p > born_q:
                now, p = born_p, self.row_of[p]
            else:  # a token after itself: row and column at the time just before it was added
                now, p, q = born_p, self.row_of[p], self.column_of[q]

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted string of arcs that spells ``word``.

        Longer arcs are tried first; a position from which nothing leads on is marked dead and
        never entered again, so the work stays linear in the word's length.
        """
        n, at, length, shorter, arcs = len(word), 0, self.length, self.shorter, self.arcs
        path: list[int] = []
        dead = bytearray(n + 1)
        token, last = self._longest(word, 0), -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    allowed = last < 0 or arcs.get(last << 32 | token)
                    if allowed or allowed is None and self.has_arc(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                last, at, token, node = token, end, -1, self.trie
                for b in memoryview(word)[end:]:
                    hit = node.get(b)
                    if hit is None:
                        break
                    found, node = hit
                    if found >= 0:
                        token = found
            else:
                dead[at] = 1
                token = path.pop()
                at -= length[token]
                last = path[-1] if path else -1
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


def load_tokenizer(path: str) -> dict:
    """Vocabulary, merges and added tokens of a byte-level BPE file, read on the driver (a few MB)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {"vocab": spec["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class Codec:
    """Splits texts, keeps the ids of recent words, and joins what the automaton returns."""

    def __init__(self, spec: dict, kept_words: int = 100_000):
        import regex

        self.automaton = TokenAutomaton(spec["vocab"], spec["merges"], spec["special"])
        self.split, self.split_latin1 = regex.compile(SPLIT), re.compile(SPLIT_LATIN1)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(spec["special"], key=len, reverse=True))) + ")") if spec["special"] else None
        self.special_ids = spec["special"]
        self.kept_words = kept_words
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = array("I", self.automaton.encode_word(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self.words) >= self.kept_words:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        parts = self.special.split(text) if self.special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(array("I", [self.special_ids[part]]).tobytes())
                continue
            split = self.split_latin1 if _is_latin1(part) else self.split
            found = (m.group() for m in split.finditer(part)) if len(part) > 1_000_000 else iter(split.findall(part))
            while words := list(islice(found, 65_536)):
                get = self.words.get
                out.append(b"".join([get(w) or self._word(w) for w in words]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.automaton.decode(memoryview(ids)[at : at + 4_000_000].cast("I").tolist()) for at in range(0, len(ids), 4_000_000)).decode("utf-8", "replace")


def _is_latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Shared:
    """A broadcast with a name that survives pickling."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> dict:
        return self.broadcast.value


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again, and report both per row.

    Returns ``id_col``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers), ``decoded_sha256`` (UTF-8) and, with ``with_ids``, ``ids`` as binary and ``decoded``.

    A null text counts as empty (no tokens). Ids may be null or repeated: there is one row per
    input row. Very long texts are encoded whole, in time linear in their length. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    The vocabulary (a fixed file of a few MB) is broadcast; rows are independent, so nothing is
    shuffled. Added tokens of the file are matched first, as literal strings.
    """
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer_path)))
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_ids else "")

    def make():
        codec = kept(shared.id, lambda: Codec(shared.value))

        def run(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(ids)
                    out["decoded"].append(decoded)
            return out | {"id": batch.column(0)}

        return run

    return map_batches(docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")), schema, make, keeps=True).withColumnRenamed("id", id_col)
