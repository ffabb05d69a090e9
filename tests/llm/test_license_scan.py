import re

from tallyspark.llm.license_scan import CUES, TEMPLATES, Scanner, Settings, license_notices
from tests.llm.conftest import prose


def test_every_template_has_a_cue_and_finds_itself():
    scanner = Scanner(Settings())
    for i, (name, text) in enumerate(TEMPLATES):
        assert re.search(CUES, text)
        for around in ("{}", prose(1, 80) + ". {} " + prose(2, 300), "é\n\n{}\nmore of it"):
            whole = around.format(text)
            found = scanner.scan(whole)
            assert [f[0] for f in found] == [name], (i, found)
            assert found[0][5] == 1.0 and found[0][6] == ""
            assert text.startswith(whole[found[0][2]:found[0][3]])


def test_wording_differences():
    scanner = Scanner(Settings())
    name = lambda t: [(f[0], f[6]) for f in scanner.scan(t)]
    assert name("This library is licensed under the GNU General Public License, version 3.") == [
        ("GPL-3.0", "work > library")]
    assert name("This work is licensed under the GNU Lesser General Public License, version 3.") == [("LGPL-3.0", "")]
    assert name("This work is licensed under the GNU General Public License, version 7.") == []
    assert name("Licensed under CC BY-XX 4.0.") == []
    assert name("Released under the MIT License. " + prose(3, 50) + ". Licensed under CC BY-NC 4.0.") == [
        ("MIT", ""), ("CC-BY-NC-4.0", "")]
    assert name("He lost his driving license and asked for permission. " + prose(4, 60)) == []


def test_documents_against_exact_search(spark, tmp_path):
    """Every literal occurrence of a template, and nothing else, in the whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    expected = set()
    for r in docs.select("doc_id", "text").collect():
        taken = []
        for i, (name, t) in sorted(enumerate(TEMPLATES), key=lambda x: -len(x[1][1])):
            for m in re.finditer(re.escape(t.rstrip(".")), r.text or ""):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    taken.append((m.start(), m.end()))
                    expected.add((r.doc_id, name, m.start(), m.end()))
    got = {(r.doc_id, r.license, r.start, r.end) for r in license_notices(docs).collect()}
    assert got == expected and len(got) > 100


def test_odd_rows(docs, empty):
    assert license_notices(docs).collect() == [] and license_notices(empty).collect() == []
    assert license_notices(docs).columns[:3] == ["doc_id", "license", "template"]


def test_exact_notice_beside_rejected_ones():
    scanner = Scanner(Settings())
    names = lambda t: [f[0] for f in scanner.scan(t)]
    refused = "This work is licensed under the GNU Lesser General Public License, version 2.1."
    assert names(refused) == []
    for name, text in TEMPLATES:
        assert names(f"{refused} {text}") == [name] and names(f"{text} {refused}") == [name]
    # a refused wording of the same template, longer in common with it than the other's runs
    assert names("This work is licensed under the GNU General Public License, version 7, and this other work is licensed "
                 "under the old GNU General Public License, version 3.") == ["GPL-3.0"]


def test_many_notices_close_together():
    scanner = Scanner(Settings())
    order = [i * 7 % len(TEMPLATES) for i in range(1500)]
    whole, spans = "", []
    for k, i in enumerate(order):
        spans.append(len(whole))
        whole += TEMPLATES[i][1] + (" ", "\n", f" {prose(k, 9)}. ")[k % 3]
    found = scanner.scan(whole)
    assert [f[0] for f in found] == [TEMPLATES[i][0] for i in order]
    assert [f[2] for f in found] == spans and all(f[5] == 1.0 for f in found)
    equal = scanner.scan((TEMPLATES[0][1] + " ") * 1500)
    assert [f[0] for f in equal] == ["MIT"] * 1500


def test_wrapped_forms_of_every_template(spark):
    rows = [(f"{i}|{j}", prose(5, 30) + gap + text.replace(" ", gap)) for i, (_, text) in enumerate(TEMPLATES)
            for j, gap in enumerate(("\n", "  ", "\r\n\t", "\n * "))]
    found = {}
    for r in license_notices(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        found.setdefault(r.doc_id, []).append(r.license)
    assert found == {k: [TEMPLATES[int(k.split("|")[0])][0]] for k, _ in rows}
