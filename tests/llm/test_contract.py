import re

import __spark_entry__
import corpus_pipeline


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(bool(re.match(rf"op{n}_", name)) for name in names) for n in range(1, 14)] == [1] * 13
    assert names["pipeline"].__wrapped__ is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
