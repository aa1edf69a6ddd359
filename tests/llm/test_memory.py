"""What a worker keeps from stage to stage."""

from tremolo.llm import base, bpe, minhash, toxicity
from tremolo.llm.queries import VOCABULARY


def test_pipeline_other_operators_memos_are_forgotten():
    model = bpe.load(VOCABULARY)
    base.claim(model.memo, model.older, model.pairs, forget=bpe.load.cache_clear)
    assert model.encode("some words of a text") and model.memo
    model.older["x"] = (1,)
    model.pairs[1] = True
    base.claim(model.memo, model.older, model.pairs, forget=bpe.load.cache_clear)  # the next task of the same operator
    assert model.memo and bpe.load(VOCABULARY) is model
    base.claim(minhash._hasher())
    assert not model.memo and not model.older and not model.pairs and bpe.load(VOCABULARY) is not model
    minhash._hasher().hash([b"word"])
    own = toxicity._load(toxicity.pickle.dumps(toxicity.ToxicityModel(b"", b"", {}, 0.0, 0.0, (0.0,) * 4)))
    base.claim(own.memo, forget=toxicity._load.cache_clear)
    assert not minhash._hasher()
