"""op10: a chunk that a third document shares adjoins a passage of just the least length."""

from kadastra.llm import substring_dedup
from tests.llm.helpers import documents, words


def test_a_chunk_of_a_third_document_does_not_hide_a_passage(spark):
    rows, want = [], set()
    for k in range(150):
        passage, side = words(29000 + k, 51), words(19100 + k, 7 + k % 6)
        rows += [
            (10 * k, words(92000 + k, 60) + " " + side + " " + passage + " " + words(93000 + k, 50), "en", "a"),
            (10 * k + 1, words(94000 + k, 33) + " " + passage + " " + words(95000 + k, 70), "en", "a"),
            (10 * k + 2, words(96000 + k, 40) + " " + side + " " + " ".join(passage.split()[:15]) + " " + words(97000 + k, 40), "en", "a"),
        ]
        want |= {10 * k, 10 * k + 1}
    got = {r.doc_id for r in substring_dedup.repeats(documents(spark, rows)).collect()}
    assert want <= got
