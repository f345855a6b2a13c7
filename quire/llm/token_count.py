"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries, at each node, a failure link and the number
of tokens that are popped on following it, so greedy longest-match lengths
come from one pass over a word, without building pieces.  Words are split at
white space and start with the vocabulary's word mark; a character that no
piece starts with counts as its UTF-8 bytes (byte fallback).

Defined results: a null or empty text has 0 words and 0 tokens; repeated rows
each give their row; an empty table gives an empty table.  Of pieces that start
alike the longest is taken, so ties cannot arise.  A word of any length takes
one pass.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.llm._common import map_text

MARK = "▁"
#: words kept in a worker's memory; more words clear it
MEMO = 500_000


class Automaton:
    """Trie with failure links; ``popped[u]`` is the count of tokens emitted on leaving node u by its link."""

    def __init__(self, pieces):
        self.next: list[dict[str, int]] = [{}]
        token = [False]
        for piece in pieces:
            u = 0
            for c in piece:
                v = self.next[u].get(c)
                if v is None:
                    v = len(self.next)
                    self.next[u][c] = v
                    self.next.append({})
                    token.append(False)
                u = v
            token[u] = True
        n = len(self.next)
        self.fail, self.popped = [0] * n, [0] * n
        level = []
        for c, v in self.next[0].items():
            self.popped[v] = 1 if token[v] else len(c.encode())
            level.append(v)
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    count, z = self.popped[u], self.fail[u]
                    while c not in self.next[z] and z:
                        count += self.popped[z]
                        z = self.fail[z]
                    if c in self.next[z]:
                        self.fail[v], self.popped[v] = self.next[z][c], count
                    else:
                        self.fail[v], self.popped[v] = 0, count + len(c.encode())
            level = below

    def count(self, word: str) -> int:
        following, fail, popped = self.next, self.fail, self.popped
        u = total = 0
        for c in word:
            while (v := following[u].get(c)) is None:
                if not u:
                    total += len(c.encode("utf-8", "surrogatepass"))
                    v = 0
                    break
                total += popped[u]
                u = fail[u]
            u = v
        while u:
            total += popped[u]
            u = fail[u]
        return total


def load_pieces(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


_built: dict[int, Automaton] = {}


def count_tokens(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens.  The vocabulary, of a fixed size, goes to the workers once as a broadcast variable."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    memo: dict[str, int] = {}

    def one(t: str) -> tuple:
        machine = _built.get(0)
        if machine is None or getattr(machine, "of", None) is not shared.value:
            machine = Automaton(shared.value)
            machine.of = shared.value
            _built[0] = machine
        words = t.split()
        total = 0
        for w in words:
            n = memo.get(w)
            if n is None:
                n = machine.count(MARK + w)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(w) <= 64:
                    memo[w] = n
            total += n
        return len(words), total

    return map_text(docs, key, text, one, [("n_words", "long"), ("n_tokens", "long")])
