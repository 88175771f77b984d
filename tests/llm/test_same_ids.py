"""Near but unequal texts with null ids or one shared id."""

from lintlake.llm import jaccard_join, repeats

from .conftest import prose


def test_one_row_of_each_group_stays(make):
    a, b, c = prose(61, 200), prose(62, 200), prose(63, 200)
    rows = [(None, a + end, "a") for end in ("", " one", " two more")] + [(None, b + end, "a") for end in ("", " one", " one")]
    rows += [(3, c + end, "b") for end in ("", " one", " two more", " two more")] + [(4, c, "b"), (None, "", "a"), (None, None, "a")]
    kept = [r["text"] for r in jaccard_join.keep_first(make(rows)).collect()]
    assert sorted((t or "")[:20] for t in kept) == sorted(["", "", a[:20], b[:20], c[:20]])
    flags = jaccard_join.near_duplicates(make(rows)).where("kept").select("doc_id", "t").distinct().collect()
    assert sorted(str(r["doc_id"]) for r in flags) == ["3", "None", "None", "None", "None"]


def test_texts_of_one_id_have_names_of_their_own(make):
    rows = [(None, f"text {k}", "a") for k in range(200_000)]
    assert repeats.with_identity(make(rows)).select("did", "t").distinct().count() == len(rows)
