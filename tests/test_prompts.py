"""Request templates rendered as columns."""

from pyspark.sql import functions as F

from contentfit.functions import prompts as pr


def test_render_templates(one):
    x1 = one(pr.render(pr.INTENT_LABEL_TEMPLATE, {"sorgu": F.lit("reklam ver")}))
    assert '"reklam ver"' in x1 and x1.startswith("\n")
    x2 = one(pr.render(pr.IMPROVE_TEMPLATE, {"kullanici_niyeti": F.lit("niyet"), "mevcut_icerik": F.lit("metin"),
                                             "html_bolumu": F.lit("li"), "eski_skor": F.lit(0.714652)}))
    assert x2.startswith("System: \nSen bir SEO")
    assert "\nHuman: \nGirdi:\n" in x2 and "Eski Skor: 0.714652" in x2
    assert '{\n  "Kullanıcı Niyeti": "niyet",' in x2          # escaped braces become single
    x3 = one(pr.render(pr.SHORT_EDIT_TEMPLATE, {"kullanici_sorgusu": F.lit("q"), "eski_metin": F.lit("e"),
                                                "html_bolumu": F.lit("p"), "eski_skor": F.lit(0.5)}))
    assert x3.startswith("<|system|>\nRolün:") and '"kisa_duzenleme": "..."' in x3
    assert x3.endswith("Lütfen SADECE geçerli bir JSON döndür.")


def test_template_parts_literal_braces():
    assert pr.template_parts("a {{x}} {y}") == [("lit", "a {x} "), ("var", "y")]
