import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corvane.sources import pages, records

XML = """<?xml version="1.0"?>
<page xmlns="http://www.openarchives.org/OAI/2.0/"><list>
<record><header><identifier>zapis/77</identifier></header><metadata><mods ID="copy"><titleInfo><title>Prijepis</title></titleInfo></mods><mods ID="master" xmlns:etd="urn:etd">
 <subject authority="nvzz.hr"><topic lang="hrv">Biologija</topic><topic lang="eng">Ecology</topic></subject>
 <subject><topic>pelud</topic><topic> </topic></subject><subject><topic>pčele</topic><topic>pelud</topic></subject>
 <name><namePart>Kos, Lana</namePart><role><roleTerm>degree committee member</roleTerm></role></name>
 <name><namePart type="given">Vito</namePart><namePart type="family">Rak</namePart><role><roleTerm>degree committee member</roleTerm><roleTerm lang="hrv">predsjednik ispita</roleTerm></role></name>
 <name><namePart type="family">Som</namePart><namePart type="given">Iris</namePart><role><roleTerm>degree committee member</roleTerm></role></name>
 <name><namePart type="family">Prvi</namePart><namePart type="given">Stari</namePart><role><roleTerm>thesis advisor</roleTerm></role></name>
 <name><namePart type="family">Lovrak</namePart><namePart type="given">Tena</namePart><role><roleTerm>Thesis advisor</roleTerm></role></name>
 <titleInfo lang="eng"><title>Bees and pollen</title></titleInfo><titleInfo><title>  </title></titleInfo><titleInfo><title>Pčele i pelud</title></titleInfo>
 <abstract lang="eng">On bees.</abstract><abstract lang="hrv"> O pčelama. </abstract>
 <genre lang="hrv">Završni rad</genre>
 <originInfo><dateOther>ljeto</dateOther></originInfo><recordInfo><recordCreationDate encoding="w3cdtf">2019-03-02</recordCreationDate></recordInfo>
 <extension><etd:degree><etd:discipline type="studijski program" lang="eng">Biology</etd:discipline><etd:discipline type="studijski program" lang="hrv">Biologija mora</etd:discipline></etd:degree></extension>
 <identifier type="doi">10/x</identifier><identifier type="urn"> urn:nbn:hr:77 </identifier>
</mods></metadata></record>
<record><header status="deleted"><identifier>zapis/78</identifier></header></record>
</list></page>"""

TABLE = """<html><body><table class="a x y"><thead><tr><td>h</td></tr></thead><tbody>
<tr><td>P1</td><td>S1</td><td>First topic</td><td>Horvat,<br> Ana (ZEM)</td><td>9</td></tr>
<tr><td>P1</td><td>S2</td><td>-</td><td>Horvat, Ana (ZEM)</td></tr>
<tr><td>P1</td><td>S3</td></tr>
<tr><td>P1</td><td>S4</td><td>Other</td><td>-</td></tr>
</tbody></table><h3>Outcomes (3)</h3><p>Learn <b>things</b></p><p>More</p><h3>Next</h3><script>x</script>end</body></html>"""


def test_records(spark, tmp_path):
    (tmp_path / "page.xml").write_text(XML)
    rows = {r["identifier"]: r for r in records.items(records.scan(spark, str(tmp_path))).collect()}
    r = rows["zapis/77"]
    assert (r["rejected"], r["title"], r["title_en"], r["abstract"], r["abstract_en"]) == (None, "Pčele i pelud", "Bees and pollen", "O pčelama.", "On bees.")
    assert (r["advisor"]["family"], r["year"], r["kind"], r["field"], r["keywords"], r["urn"]) == ("Lovrak", 2019, "zavrsni", "Biologija", ["pelud", "pčele"], "urn:nbn:hr:77")
    assert [(c["person"]["family"], c["person"]["given"], c["role"]) for c in r["committee"]] == [("Kos", "Lana", "member"), ("Rak", "Vito", "chair"), ("Som", "Iris", "member")]
    assert r["programme"] == "Biologija mora" and rows["zapis/78"]["rejected"] == "deleted"


def test_harvest_follows_tokens_and_reads_pages_again(spark, tmp_path):
    asked = []

    def fetch(token):
        asked.append(token)
        return {None: "<p>1<resumptionToken size='3'> a </resumptionToken></p>", "a": "<p>2<resumptionToken>b</resumptionToken></p>", "b": "<p>3<resumptionToken/></p>"}[token]

    folder = f"file://{tmp_path}/pages"
    assert records.harvest(spark, folder, fetch, delay=0) == 3 and asked == [None, "a", "b"]
    (tmp_path / "pages" / "page_0002.xml").unlink()
    (tmp_path / "pages" / ".page_0002.xml.crc").unlink(missing_ok=True)
    assert records.harvest(spark, folder, fetch, delay=0) == 3 and asked[3:] == ["b"]
    assert records.harvest(spark, folder, fetch, refresh=True, delay=0) == 3 and len(asked) == 7


PROGRAMME = """<html><body><ul><li><a href="#s9" title="2. semestar">II</a></li><li><a href="#s4">1. semestar</a></li><li><a href="#x">O studiju</a></li></ul>
<h1>Studij <b>mora</b></h1><div id="x"><div class="coursebox-content"><a href="/predmet/zz">Elsewhere</a></div></div>
<div id="s4"><div class="wrap"><h4 class="grouptitle">Obvezni predmeti</h4>
<div class="coursebox-content box"><div class="leftcont">ECTS 4,5</div><a href="/predmet/alg?x=1">Alge <i>i</i> gljive</a><br></div>
<div class="coursebox-content"><a href="/predmet/alg">Alge again</a></div><div class="coursebox-content">Bez veze</div></div>
<h4 class="grouptitle">Izborni moduli (2)</h4><div class="coursebox-content"><a href="/predmet/rib/">Ribe</a></div>
<h4 class="grouptitle">Izborni transverzalni (1)</h4><div class="coursebox-content"><a href="/predmet/tra">Govor</a></div></div>
<div id="s9"><div class="coursebox-content"><a href="/predmet/alg">Alge</a><div class="leftcont">6</div></div></div></body></html>"""


def test_programme_pages(spark):
    docs = spark.createDataFrame([("p", PROGRAMME), ("q", None), ("r", "<p>nothing</p>")], "path string, html string")
    rows = sorted(pages.programme_courses(docs).collect(), key=lambda r: r["place"])
    assert [(r["state"], r["code"], r["semester"]) for r in rows] == [("row", "alg", 1), ("repeated", "alg", 1), ("no link", "", 1), ("row", "rib", 1), ("transversal", "tra", 1), ("row", "alg", 2)]
    good = [r for r in rows if r["state"] == "row"]
    assert [(r["name"], r["credits"], r["is_elective"], r["elective_group"]) for r in good] == [("Alge i gljive", 4.5, False, None), ("Ribe", None, True, "Izborni moduli"), ("Alge", 6.0, False, None)]
    assert {r["programme"] for r in rows} == {"Studij mora"} and rows[2]["text"] == "Bez veze"


def test_named_files_labels_and_leaf_links(spark, tmp_path):
    (tmp_path / "a.html").write_text('<h3>Ishodi</h3><p>one</p><h3>Sadržaj</h3><p>two</p><a href="/studiji/dipl/rac/x1">l</a><a href="/studiji/dipl/bio/y">m</a>')
    files = pages.listed(spark, str(tmp_path), {"a.html": "diplomski"})
    assert [r["kind"] for r in files.collect()] == ["diplomski"]
    with pytest.raises(AnalysisException):
        pages.listed(spark, str(tmp_path), {"a.html": "x", "missing.html": "y"}).collect()
    found = pages.labelled(pages.sections(files), "path", ["Opis", "Sadržaj", "Ishodi"]).collect()
    assert [(r["heading"], r["text"]) for r in found] == [("Sadržaj", "two l m")]
    links = pages.leaf_links(files, r"^/studiji/dipl/([a-z]+)/[^/]+$", {"rac": "Computing"}).collect()
    assert sorted((r["link"], r["area"]) for r in links) == [("/studiji/dipl/bio/y", "BIO"), ("/studiji/dipl/rac/x1", "Computing")]


def test_schedule_and_sections(spark, tmp_path):
    (tmp_path / "a.html").write_text(TABLE)
    (tmp_path / "b.html").write_text("<p>nothing</p>")
    scanned = pages.scan(spark, str(tmp_path))
    rows = pages.schedule(scanned, "x y", 2026).collect()
    assert sorted(r["rejected"] or "" for r in rows) == ["", "no supervisor", "no table", "no title", "too few cells"]
    (good,) = [r for r in rows if not r["rejected"]]
    assert (good["family"], good["given"], good["unit"], good["title"], len(good["ext_id"])) == ("Horvat", "Ana", "ZEM", "First topic", 24)
    found = [(r["heading"], r["text"]) for r in pages.sections(scanned).orderBy("place").collect()]
    assert found == [("Outcomes (3)", "Learn things More"), ("Next", "end")]


def test_labels(spark):
    rows = spark.createDataFrame([("Izborni predmeti (3)", "ECTS: 4,5"), ("Izborni transverzalni", "x"), ("Obvezni", "6")], "a string, b string")
    got = [tuple(r) for r in rows.select(pages.group_kind(F.col("a")), pages.group_name(F.col("a")), pages.number(F.col("b"))).collect()]
    assert got == [("elective", "Izborni predmeti", 4.5), ("skip", "Izborni transverzalni", None), ("mandatory", "Obvezni", 6.0)]
    assert pages.file_name("https://a.b/c/d?e=1") == "a_b_c_d_e_1.html"
