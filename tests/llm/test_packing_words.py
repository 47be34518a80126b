"""Words of ASCII letters are one part: no pattern is asked."""

import pyarrow as pa
from tokenizers import Tokenizer

from citeloom.llm import hist_pack
from citeloom.llm.queries import TOKENIZER


class Counted:
    def __init__(self, pattern):
        self.pattern, self.asked = pattern, []

    def __getattr__(self, name):
        return lambda word: self.asked.append(word) or getattr(self.pattern, name)(word)


def test_words_of_letters_need_no_pattern(monkeypatch):
    monkeypatch.setattr(hist_pack, "PLAIN", Counted(hist_pack.PLAIN))
    monkeypatch.setattr(hist_pack, "PARTS", Counted(hist_pack.PARTS))
    texts = ["Alpha beta GAMMA  alpha it's", "x1 naïve ªb <|end|> don't ABC", "q" * 60 + " tail", ""]
    got = hist_pack.WordEncoder(TOKENIZER)(pa.array(texts))
    whole = Tokenizer.from_file(TOKENIZER)
    assert [x.tolist() for x in got] == [whole.encode(x, add_special_tokens=False).ids for x in texts]
    assert {w.lower() for w in hist_pack.PLAIN.asked if w} == {"it's", "x1", "naïve", "ªb", "<|end|>", "don't", "q" * 60}
    assert "alpha" not in hist_pack.PARTS.asked
