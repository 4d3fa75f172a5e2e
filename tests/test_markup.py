"""Page cleaning."""

from textlab.functions import markup as M

PAGE = """<html><head><title>T &amp; T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<!-- c --><h1>Jan  Kowalski</h1><p>Marszałek: Proszę</p><p>To jest (Oklaski na sali) zdanie [Dzwonek].</p>
<p>Głos ma pan X</p><table><tr><td>Staż:</td><td>dwie <b>kadencje</b></td></tr>
<TR><th><b>Szkoła: </b></th><TD>AGH</TD></TR><tr><td>a Okręg b</td><td>13</td></tr></table>
<ul><li><a>Zawód</a></li><li><a>lekarz</a></li></ul></body></html>"""


def test_entities_are_decoded_once(one):
    text = "&lt;b&gt; &amp;lt; &#321; &#x142; &#X142; &copy; &bogus; & &apos; &#0; &#1114112;"
    assert one(M.decode_entities, x=text) == "<b> &lt; Ł ł ł © &bogus; & ' &#0; &#1114112;"


def test_html_text_drops_scripts_styles_comments(one):
    text = one(M.html_text, x=PAGE)
    assert "var x" not in text and "p{}" not in text and " c " not in text
    assert "T & T" in text and "Jan  Kowalski" in text


def test_clean_text(one):
    text = one(M.clean_text, x=PAGE)
    assert text.startswith("T & T Jan Kowalski To jest zdanie .")
    assert "Marszałek" not in text and "Głos ma" not in text


def test_strict_rules_are_off_by_default(one):
    line = "Panie pośle, proszę"
    page = f"<p>{line}</p><p>12. posiedzenie</p><p>Pan poseł Nowak</p>"
    assert one(M.clean_text, x=page) == f"{line} 12. posiedzenie Pan poseł Nowak"
    assert one(lambda x: M.clean_text(x, strict_rules=True), x=page) == line


def test_heading_falls_back_to_title(one):
    assert one(M.page_heading, x=PAGE) == "Jan Kowalski"
    assert one(lambda x: M.page_heading(x, banned="Kowalski"), x=PAGE) == "T & T"
    assert one(lambda x: M.page_heading(x, max_len=3), x=PAGE) == "T & T"


def test_label_values(one):
    assert one(lambda x: M.label_value(x, "Staż:"), x=PAGE) == "dwie kadencje"
    assert one(lambda x: M.label_value(x, "Szkoła:"), x=PAGE) == "AGH"
    assert one(lambda x: M.label_value(x, "Zawód"), x=PAGE) == "lekarz"
    assert one(lambda x: M.label_value(x, "Okręg"), x=PAGE) == "13"
    assert one(lambda x: M.label_value(x, "Brak"), x=PAGE) is None


def test_blocked(one):
    assert one(M.is_blocked, x="<p>please enable javascript</p>") is True
    assert one(M.is_blocked, x=PAGE) is False


def test_long_pages_do_not_overflow_the_matcher(one):
    page = "<table><tr><td>x</td><td>" + "lorem <i>ipsum</i> " * 40_000 + "</td></tr></table><h1>N</h1>"
    assert one(M.page_heading, x=page) == "N"
    assert one(lambda x: M.label_value(x, "x"), x=page).startswith("lorem ipsum lorem")
    assert len(one(M.clean_text, x=page)) > 400_000
