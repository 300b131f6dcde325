"""Frequent words stay in the encoder's cache while words met once pass through; greedy tokens that do not fit are stepped back from."""

from loadloom.llm import bpe


def test_frequent_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 40)
    made = []
    words = bpe._Cache(lambda w: made.append(w) or w.encode())
    for n in range(400):
        assert words["the"] == b"the" and words[f"once{n}"] == f"once{n}".encode()
        assert len(words) + len(words.old) <= 40
    assert made.count("the") == 1 and len(made) == 401
    words.clear()
    assert not words and not words.old


def test_tokens_are_what_the_merges_give():
    codec = bpe.Codec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    stepped = 0
    for word in ("oueuxeuxê", "thatthntinger", "unenréreè", "andershreou", "a" * 50, "!" * 33, "x", "erheenst", "aileoitre"):
        letters = "".join(codec.letters[b] for b in word.encode()) + bpe.END
        parts = [*letters]
        while ranked := [(codec.merge[p][0], i) for i, p in enumerate(zip(map(codec.token.index, parts), map(codec.token.index, parts[1:]), strict=False)) if p in codec.merge]:
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert [codec.token[t] for t in codec.encode_letters(letters)] == parts
        stepped += parts != [codec.token[t] for _, t in codec.automaton.iter_long(letters)]
    assert stepped
