import public_tokenizers

from brisa.llm import common, sentencepiece_fst


def test_a_worker_that_takes_up_another_operator_forgets():
    path = public_tokenizers.path("piece_bpe_32k.model")
    first = sentencepiece_fst.transducer(path)
    ids = first.encode("the same text again")
    assert first.paths and sentencepiece_fst.transducer(path) is first
    assert list(common.given_back(iter)([1, 2])) == [1, 2]
    again = sentencepiece_fst.transducer(path)
    assert again is not first and not again.paths
    assert again.encode("the same text again") == ids
