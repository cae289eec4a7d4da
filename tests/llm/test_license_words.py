import pytest

from spectraloom.llm import license_scan


@pytest.mark.parametrize("pad", ["", "lorem ipsum dolor "])
def test_a_word_left_out_or_put_in(spark, documents, pad):
    apache = "licensed under the apache license version 2 0"
    cases = [
        ("released under mit license", "mit-notice", 0.8),
        ("released under the new mit license", "mit-notice", 1.0),
        ("released now under the mit license", "mit-notice", 0.8),
        ("released under the mit open license", "mit-notice", 0.8),
        ("licensed under apache license version 2.0", "apache-2.0", 7 / 8),
        (apache.replace("version ", ""), "apache-2.0", 7 / 8),
        (apache.replace("under the", "under only the"), "apache-2.0", 1.0),
        (apache.replace("version", "version no"), "apache-2.0", 1.0),
    ]
    docs = documents([pad + t + " " + pad for t, _, _ in cases])
    spans = license_scan.license_spans(docs, license_scan.template_table(spark)).where("not is_base").collect()
    for i, (_, label, coverage) in enumerate(cases):
        assert [r.coverage for r in spans if r.doc_id == i and r.label == label] == [coverage]


def test_chance_pairs_beside_a_notice_do_not_hide_it(spark, documents):
    texts = ["mit license " * 9 + "released under the mit license", "the mit license under the mit license " * 3, "released under " + "mit license " * 9]
    texts.append("under the under the released under the mit license mit license mit license")
    out = {r.doc_id: r for r in license_scan.license_labels(documents(texts), license_scan.template_table(spark)).collect()}
    assert ["mit-notice" in out[i].labels.split(",") for i in range(4)] == [True] * 4
