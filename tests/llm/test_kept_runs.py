"""What an encoder keeps of the texts it has read."""

import numpy as np
from public_tokenizers import path

from termweave.llm.packing import Kept, WordIds


def test_signs_and_digits_on_a_word_make_nothing_new_to_keep():
    enc = WordIds(path("word_bpe_49k.json"))
    words = [f"{w}{s}{n}" for w in ("anse", "pol", "été") for s in ("", ".", "::", "'s") for n in range(200)]
    text = " ".join(words)
    assert enc.encode(text) == np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    kept = sum(len(v) + len(v.old) for v in vars(enc).values() if isinstance(v, Kept))
    assert kept == len(set(enc.split(text))) < 20
