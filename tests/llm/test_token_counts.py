import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from credence.llm import token_counts as tc
from credence.llm._common import read_table
from tests.llm.oracle import SF

SMALL = {"▁": -3.0, "▁a": -1.5, "ab": -2.0, "a": -2.5, "b": -2.5, "bab": -4.0, "▁ab": -3.5, "é": -6.0}


def brute(word, scores, longest):
    """Best segmentation by plain search over all cuts, from the end, without a trie."""
    marked = tc.MARK + word
    top, worst = max(scores.values()), min(scores.values())
    best = [(0, 0)]  # cost and tokens of the rest, from the end on
    for i in range(len(marked) - 1, -1, -1):
        options = [(round(1e6 * (top - scores[p])) + best[j - i - 1][0], 1 + best[j - i - 1][1]) for j in range(i + 1, min(len(marked), i + longest) + 1) if (p := marked[i:j]) in scores]
        if marked[i] not in scores:
            options.append((round(1e6 * (top - worst + tc.UNKNOWN)) + best[0][0], len(marked[i].encode()) + best[0][1]))
        best.insert(0, min(options))
    return best[0][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abé☃", min_size=1, max_size=9), max_size=12))
def test_trie_equals_plain_search(words):
    trie = tc.Trie(tc.vocabulary_of(SMALL))
    assert [trie.count(w) for w in words] == [brute(w, SMALL, 3) for w in words]


def test_prefixes_are_scored_once():
    trie = tc.Trie(tc.vocabulary_of(SMALL))
    for word in ("abab", "abba", "ab", "abab"):
        trie.count(word)
    prefixes = {(tc.MARK + w)[:i] for w in ("abab", "abba", "ab") for i in range(6)}
    assert len(trie.best) == len(prefixes) == 8 and len(trie.child) == 7


def test_whole_table_equals_plain_search(spark):
    """Scores as the file states them, over every distinct word of the table."""
    model = sentencepiece.SentencePieceProcessor(model_file=tc.DEFAULT_VOCABULARY)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    longest, known = max(map(len, scores)), {}
    docs = read_table(spark, SF, "documents")
    old, tc.NODES = tc.NODES, 20_000  # tries are given up now and then
    try:
        got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tc.token_counts(docs).collect()}
    finally:
        tc.NODES = old
    for r in docs.collect():
        words = [w for w in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        for w in words:
            if w not in known:
                known[w] = brute(w, scores, longest)
        assert got[r.doc_id] == (len(words), sum(known[w] for w in words))


def test_table(spark):
    docs = spark.createDataFrame([(1, "Hello  hello\nworld", "x"), (2, None, "y"), (None, "z" * 50_000, "z"), (1, "Hello  hello\nworld", "x"), (3, " \t", "")], "doc_id long, text string, n_tokens string")
    got = tc.token_counts(docs).collect()
    assert len(got) == 5
    by = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in got}
    trie = tc.Trie(tc.load_vocabulary())
    assert by[1] == (3, sum(map(trie.count, ("Hello", "hello", "world")))) and by[2] == by[3] == (0, 0) and by[None][0] == 1
    assert tc.token_counts(docs.limit(0)).count() == 0
