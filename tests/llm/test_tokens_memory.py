import public_tokenizers
from fixtures import prose

from trackgrid.llm import tokens


def test_few_texts_are_cut_at_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [prose(50, i) for i in range(40)] + ["", "one"] + [prose(2000, 9)]
    want = tokens.CachedTokenizer(path).encode(texts)
    monkeypatch.setattr(tokens, "LETTERS", 1000)
    small, asked = tokens.CachedTokenizer(path), []
    some = small._some
    monkeypatch.setattr(small, "_some", lambda t: asked.append(sum(map(len, t[:-1]))) or some(t))
    assert small.encode(texts) == want and small.encode([]) == []
    assert len(asked) > 10 and max(asked) < 1000
