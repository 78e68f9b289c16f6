"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes carry a failure link and the number of tokens that are popped
when the link is followed, so greedy longest-match piece counts come from one pass over a word's bytes,
without building the pieces. A word that no sequence of pieces covers counts as one unknown token.

Null and empty texts have no words and no tokens. Rows are never merged: repeated rows and ties give one
result each. Texts and words of any length are counted whole. Extra columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame

from hushjoin.llm.common import CACHES, WORD, map_columns

MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    back = byte_alphabet()
    return [bytes(back[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


class Automaton:
    """Trie with failure links and popped-token counts. Node 0 is the root; a link of -1 means no cover."""

    def __init__(self, pieces: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = {0: False}
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                node = nxt
            if piece:
                ends[node] = True
        self.link, self.pops = [-1] * len(self.child), [0] * len(self.child)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.child[u].items():
                queue.append(v)
                if ends.get(v):
                    self.link[v], self.pops[v] = 0, 1
                    continue
                z, popped = self.link[u], self.pops[u]
                while z >= 0 and b not in self.child[z]:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.child[z][b], popped

    def count(self, word: bytes) -> int:
        """Greedy longest-match pieces of word; -1 if they cannot cover it."""
        child, link, pops = self.child, self.link, self.pops
        u = n = 0
        for b in word:
            nxt = child[u].get(b)
            while nxt is None:
                n += pops[u]
                u = link[u]
                if u < 0:
                    return -1
                nxt = child[u].get(b)
            u = nxt
        while u:
            n += pops[u]
            u = link[u]
            if u < 0:
                return -1
        return n


class Counts(dict):
    """Word to count, filled on demand and emptied at a fixed size."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
        return n


_built: dict[str, Counts] = {}


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_tokens and n_unknown (words no pieces cover, one token each) of every whole text.

    A word is taken with one space before it, as byte-level vocabularies spell the start of a word.
    vocab_path must be readable where tasks run; the automaton's size is that of the vocabulary file.
    """

    def start():
        if vocab_path not in _built:
            _built[vocab_path] = Counts(Automaton(vocabulary(vocab_path)))
            CACHES.append(_built[vocab_path])
        memo = _built[vocab_path]

        def mapper(cols):
            words, tokens, unknown = [], [], []
            for text in cols["text"]:
                found = WORD.findall(text) if text else []
                counts = [memo[w] for w in found]
                bad = counts.count(-1)
                words.append(len(found))
                tokens.append(sum(counts) + 2 * bad)
                unknown.append(bad)
            return {id_col: cols[id_col], "n_words": words, "n_tokens": tokens, "n_unknown": unknown}

        return mapper

    src = docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text")
    kind = src.schema[id_col].dataType.simpleString()
    return map_columns(src, start, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")
