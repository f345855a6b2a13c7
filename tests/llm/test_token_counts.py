import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries, token_count

PIECES = ["▁", "▁a", "a", "ab", "▁ab", "abc", "bca", "c", "cab", "caba", "é", "▁aba"]
MACHINE = token_count.Automaton(PIECES)


def lengths(pieces):
    longest = {}
    for p in pieces:
        longest[p[0]] = max(len(p), longest.get(p[0], 0))
    return longest


def greedy(word, pieces, longest):
    at = total = 0
    while at < len(word):
        for n in range(min(longest.get(word[at], 0), len(word) - at), 0, -1):
            if word[at : at + n] in pieces:
                total, at = total + 1, at + n
                break
        else:
            total, at = total + len(word[at].encode()), at + 1
    return total


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcdé🙂", max_size=30))
def test_counts_by_greedy_search(word):
    assert MACHINE.count("▁" + word) == greedy("▁" + word, set(PIECES), lengths(PIECES))


def test_query_by_greedy_search(spark, small):
    pieces = set(token_count.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen, longest = {}, lengths(pieces)
    for row in queries.op3_token_counts(spark, small).collect():
        words = texts[row["doc_id"]].split()
        for w in set(words) - set(seen):
            seen[w] = greedy("▁" + w, pieces, longest)
        assert (row["n_words"], row["n_tokens"]) == (len(words), sum(seen[w] for w in words))


def test_odd_rows(odd, none):
    rows = token_count.count_tokens(odd, PIECES).collect()
    assert len(rows) == 12
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    assert token_count.count_tokens(none, PIECES).count() == 0
