"""Names, labels and contexts of a page, as a browser would have them."""

from pyspark.sql import functions as F

from hushlake.sources import dom

PAGE = """
<html><head><title>no</title><script>var x = "<p>no</p>"</script></head><body>
<h1>Your <b>account</b></h1>
<dl><dt>Date of birth</dt><dd>14/03/2001</dd><dt>City</dt><dd>Pune</dd></dl>
<table><thead><tr><th>Date</th><th>Account number</th></tr></thead><tr><td>1 May</td><td data-pii="ACCOUNT">123456789</td></tr></table>
<form>
<label for=a>Full name</label><input id=a name=n value=Asha autocomplete=name required>
<label>Phone <input type=tel></label>
<span id=l1>Home</span><span id=l2>address</span><textarea aria-labelledby="l1 l2">Pune 1</textarea>
<input placeholder="PAN here"><input type=password value=secret title=Secret><input type=hidden value=x>
<b>Gender</b><input type=radio name=g value=f checked><input type=search aria-label=Find>
<select title=State><option>Goa</option><option>Kerala</option></select>
<input type=submit value=Send><button disabled>Go <i>now</i></button><a href=/x>More</a><a>no link</a>
<div role=switch>Dark</div><div contenteditable>14/2 Marg</div>
</form>
<p>A paragraph that mentions a one-time password, long enough not to be a label.</p><p>4321</p>
<img src=a.png alt=Photo width=96 height=96><img src=dot.gif width=1 height=1><iframe src=https://pay.test width=300 height=200></iframe><iframe srcdoc="x"></iframe>
</body></html>
"""


def page(spark):
    return dom.snapshots(spark.createDataFrame([(7, PAGE), (8, None), (None, "<p>x")], "page_id long, html string"))


def test_controls(spark):
    rows = dom.controls_of(page(spark)).where("page_id = 7").orderBy("ord").collect()
    assert [(r.role, r.name) for r in rows] == [
        ("textbox", "Full name"), ("textbox", "Phone"), ("textbox", "Home address"), ("textbox", "PAN here"), ("textbox", "Secret"),
        ("radio", "Gender"), ("searchbox", "Find"), ("combobox", "State"), ("button", "Send"), ("button", "Go now"), ("link", "More"),
        ("switch", "Dark"), ("textbox", "Dark"),
    ]
    by = {r.name: r for r in rows}
    assert by["Full name"].required and by["Full name"].value == "Asha" and by["Full name"].autocomplete == "name"
    assert by["Secret"].value is None
    assert by["State"].options == ["Goa", "Kerala"] and by["Gender"].checked and by["Gender"].group == "g" and by["Go now"].disabled
    assert dom.controls_of(page(spark), most=3).where("page_id = 7").count() == 3


def test_blocks(spark):
    rows = {r.text: r for r in dom.listed(page(spark), "blocks").where("page_id = 7").collect()}
    assert rows["Your account"].tag == "h1"
    assert rows["14/03/2001"].label == "Date of birth" and "Date of birth" in rows["14/03/2001"].context
    assert rows["City"].label is None
    assert "Account number" in rows["123456789"].context and "Account number" not in rows["1 May"].context
    assert "password" not in rows["4321"].context
    assert not any("var x" in t or t == "no" for t in rows)


def test_images_frames_truth(spark):
    s = page(spark).where("page_id = 7")
    assert [(r.src, r.width) for r in dom.listed(s, "images").collect()] == [("a.png", 96.0)]
    assert [r.src for r in dom.listed(s, "frames").collect()] == ["https://pay.test"]
    assert [(r.type, r.text) for r in dom.listed(s, "truth").collect()] == [("ACCOUNT", "123456789")]


def test_odd_pages(spark):
    rows = {r.page_id: r for r in page(spark).collect()}
    assert rows[8].elements == [] and rows[8].blocks == []
    assert [b.text for b in rows[None].blocks] == ["x"]
    deep = spark.createDataFrame([(1, "<div>" * 20_000 + "end")], "page_id long, html string")
    assert [b.text for b in dom.snapshots(deep).first().blocks] == ["end"]


def test_stable_ids(spark):
    seen = spark.range(2500).select(F.lit(1).alias("page"), (F.col("id") * 7 % 2500).alias("thing"), F.col("id").alias("at"))
    rows = {r.thing: r for r in dom.stable_ids(seen, "page", "thing", "at").collect()}
    assert (rows[0].id, rows[0].epoch) == (1, 0) and (rows[999 * 7 % 2500].id, rows[999 * 7 % 2500].epoch) == (1, 1)
    assert max(r.id for r in rows.values()) == 999
