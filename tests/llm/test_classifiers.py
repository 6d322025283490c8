"""Language, quality classifier and page extraction: held-out accuracy and edge cases."""

import re
import html as H

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidestate.llm import dom, html_extract, language_id, quality_classifier, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edge_cases(edge, empty):
    learn = F.col("doc_id").isNotNull() & ~language_id.held_out()
    model = language_id.fit(edge, learn)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(edge, model).collect()]
    assert len(got) == edge.count()
    assert all(p == "und" and s == 0 for i, p, s in got if i in (2, 3, 4, 10))
    assert all(p != "und" for i, p, _ in got if i in (1, 7, 8))
    assert language_id.fit(empty, learn) is None
    assert language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}


def test_quality_held_out(spark):
    got = queries.op7_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert got.select(F.avg(((F.col("predicted") == 1) == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.9


def test_quality_edge_cases(spark, edge, empty, no_labels):
    learn = F.col("doc_id").isNotNull() & ~quality_classifier.held_out()
    assert quality_classifier.fit(edge, no_labels, learn) is None
    labels = spark.createDataFrame([(1, 1, None, "x"), (1, 0, 1, "x"), (6, 0, 0, "x"), (8, 1, 0, "x"), (None, 1, 0, "x"), (9, None, 0, "x"), (11, 1, 1, "x"), (7, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = quality_classifier.fit(edge, labels, F.col("doc_id").isNotNull())
    rows = quality_classifier.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.score(edge, None).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1, 1, -1, -1])
    w, b = quality_classifier.dual_descent(rows, y, np.ones(quality_classifier.GRAMS.dims))
    assert all((w[f].sum() / np.sqrt(2) + b) * s > 0 for f, s in zip(rows, y, strict=True))


def want(page):
    a = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", a)]
    return " ".join(x for x in blocks if x)


def test_pages(spark):
    rows = html_extract.html_extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    exact = sum(r.text == want(pages[r.page_id]) for r in rows)
    assert exact >= 0.98 * len(rows) and all(r.n_chars == len(r.text) for r in rows)


def test_made_up_pages_held_out():
    maker, right, all_, kept = html_extract.Maker(4242), 0, 0, 0
    trees = html_extract.model()
    for _ in range(120):
        page = maker.page()
        main = [x.text.replace(html_extract.MARK, "") for x in dom.parse(page) if html_extract.MARK in x.text]
        got = html_extract.extract([page.replace(html_extract.MARK, "")], trees)[0].split()
        main = " ".join(main).split()
        common = len(set(got) & set(main))
        right, all_, kept = right + common, all_ + len(set(main)), kept + len(set(got))
    assert right / all_ > 0.97 and right / kept > 0.95


BODY = "<p>The river ran past the old mill, and every stone in it was known to the miller.</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        (None, ""),
        ("<nav><a href='/'>Home</a></nav>", ""),
        (f"<nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>A&amp;B &eacute;</h1>{BODY * 3}</article><footer>&copy; us</footer>", "A&B é" + (" " + BODY[3:-4]) * 3),
        (f"<article>{BODY}<script>var t='</p>';</script><style>p{{}}</style><!-- <p>no</p> -->{BODY}</article>", f"{BODY[3:-4]} {BODY[3:-4]}"),
        (f"<body><article>{BODY}{BODY}</article><div class='comments'><h3>Comments</h3><div class='comment'><p>Nice words indeed, thank you.</p></div></div>", f"{BODY[3:-4]} {BODY[3:-4]}"),
    ],
)
def test_page_cases(page, text):
    assert html_extract.extract([page or ""], html_extract.model())[0] == text


def test_page_table_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", f"<article>{BODY}", "x"), (None, None, "<<<>>>&&& <p", "x"), (2, "u", "<div>" * 3000 + "deep" + "</div>" * 10, "x")], "page_id long, url string, html string, text string")
    assert html_extract.html_extract(df).count() == 4
    assert html_extract.html_extract(df.limit(0)).count() == 0


LINE = BODY[3:-4]


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<svg class='icon' viewBox='0 0 1 1'/>", ""),
        ("<math/>", ""),
        ("<p><svg><path d='M0'/></svg></p>", ""),
        ("<div><select><option>no</div>", ""),
        ("<div><noscript><img src='x'></div>", ""),
        ("<div><noscript>no<div>no</div>no</noscript></div>", ""),
        ("<div><textarea>no</div>", ""),
        ("<div><select><option>no</div><div><select><option>no</select></div>", ""),
        ("<template><div>no<p>no</div></template>", ""),
        (f"<object data='x'>{BODY}</object>", LINE),
        (f"<object data='x'>{BODY}", LINE),
        (f"<p>{LINE} <math><mi>x</mi></math> {LINE}</p>", f"{LINE} x {LINE}"),
    ],
)
def test_elements_that_hold_no_page_text(inside, text):
    page = f"<body><article>{BODY}{inside}{BODY}</article>"
    assert " ".join(x.text for x in dom.parse(page) if x.text) == " ".join(x for x in (LINE, text, LINE) if x)
    got = html_extract.extract([page], html_extract.model())[0]
    assert got == " ".join(x for x in (LINE, text, LINE) if x)


@pytest.mark.parametrize("tag", ["select", "noscript", "object", "svg", "textarea"])
def test_unclosed_elements_of_the_body(tag):
    assert [x.text for x in dom.parse(f"<{tag}><article>{BODY}</article>") if x.text] == [LINE]


def test_many_unclosed_elements_are_read_once():
    assert dom.parse("<div><textarea></div>" * 30_000 + "end")[-1].text == "end"


@pytest.mark.parametrize("family", list(html_extract.FAMILIES))
def test_family_of_layouts_held_out(family):
    """Pages of a family that neither tokens nor trees have seen."""
    fitted = html_extract.fit(html_extract.Maker(11, tuple(f for f in html_extract.FAMILIES if f != family)), 400)
    maker, right, all_, kept = html_extract.Maker(77, (family,)), 0, 0, 0
    for _ in range(80):
        page = maker.page()
        main = set(" ".join(x.text.replace(html_extract.MARK, "") for x in dom.parse(page) if html_extract.MARK in x.text).split())
        got = set(html_extract.extract([page.replace(html_extract.MARK, "")], fitted)[0].split())
        right, all_, kept = right + len(got & main), all_ + len(main), kept + len(got)
    print(f"{family}: recall {right / all_:.4f}, precision {right / kept:.4f}")
    assert right / all_ > 0.95 and right / kept > 0.95


def test_attribute_words_are_learned():
    """Log odds come from counts alone: a word that no list has tells as much as any other."""
    page = "<div class='zorp'><p>{}x</p></div><div class='quux'><p>y</p></div>".format(html_extract.MARK)

    class Fixed:
        def page(self):
            return page

    told = html_extract.log_odds(html_extract.labelled(Fixed(), 20))
    (zorp,), (quux,) = dom.tokens(" class='zorp'"), dom.tokens(" id=quux")
    assert told[zorp] > 2 and told[quux] < -2 and (told != 0).sum() == 2


@pytest.mark.parametrize("part", ["<font>x ", "<div><p>x ", "<a <b ", '<a "', "<p>", "<!", "<ul><li>x", "</i>", "<i><div><font></i>", '<a href="'])
def test_time_in_proportion_to_the_page(part):
    import time

    fitted = html_extract.model()
    took = []
    for size in (200_000, 2_000_000):
        began = time.process_time()
        html_extract.extract([part * (size // len(part))], fitted)
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.2)
