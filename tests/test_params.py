"""One failing value per validator."""

import pytest

from gramvec.params import Params


@pytest.mark.parametrize(
    "kw",
    [
        dict(steps=0), dict(vocabulary_size=0), dict(vocabulary_size=10251099), dict(batch_size=0),
        dict(embedding_size=0), dict(skip_window=0), dict(num_sampled=0), dict(ngram_size=2), dict(ngram_size=7),
        dict(num_buckets=1), dict(learnrate=0.001), dict(learnrate=1.5), dict(rejection_threshold=0),
        dict(rejection_threshold=1.5), dict(num_batch_files=0), dict(language="klingon"), dict(passes=0),
        dict(num_sampled=60000),
    ],
)
def test_invalid(kw):
    with pytest.raises(ValueError):
        Params(**kw)


def test_defaults_and_words():
    p = Params(validation_words="one,two,king")
    assert p.validation_words_list == ["one", "two", "king"]
    assert Params().validation_words_list is None
    assert p.effective_query_ngram_size == 3 and p.replace(query_ngram_size=2).effective_query_ngram_size == 2
