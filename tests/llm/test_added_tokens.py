"""The encoder equals the tokenizer where texts hold its added tokens."""

import random

import pyarrow as pa

from loomgraph.llm import packing
from loomgraph.llm.queries import vocabulary


def test_encoder_takes_added_tokens_whole():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    r = random.Random(6)
    atoms = ["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "a", "É", "'s", "日本", "end."]
    texts = ["end.<|endoftext|>New doc", "a<|endof", "text|>b", *("".join(r.choice(atoms) for _ in range(r.randint(0, 20))) for _ in range(300))]
    assert plain.encode(texts[0], add_special_tokens=False).ids.count(50256) == 1
    data, off = packing.T.flat(pa.array(texts))
    coder = packing.Encoder(vocabulary())
    for i, j in packing.T.slices(off, 1000):
        ids, ptr = coder.encode(data[off[i] : off[j]], off[i : j + 1] - off[i], 0)
        for k in range(j - i):
            assert ids[ptr[k] : ptr[k + 1]].tolist() == [*plain.encode(texts[i + k], add_special_tokens=False).ids, 0]
