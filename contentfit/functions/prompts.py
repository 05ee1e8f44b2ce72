"""Generation request texts as columns (X1-X3), for offline batch inference.

A template is plain text with ``{name}`` placeholders; :func:`render` turns
it into one ``concat`` of literals and columns (JVM-side, no Python per
row).  Generated outputs come back as a table and are read by
:func:`contentfit.operators.improve.attempt_texts`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")

# --- fixed values: request templates of the reference ------------------------
# Intent label for a search query.
INTENT_LABEL_TEMPLATE = """
Bir kullanıcı şu arama sorgusunu yazdı: "{sorgu}"

Bu sorgunun özünde hangi amaç yatıyor?

Lütfen yalnızca 3–5 kelimelik, sade ve tematik bir niyet ifadesi ver.
Bir etiket ya da başlık gibi düşün. Nokta veya açıklama yazma.
"""

# Short edit of a section for a query (system part, then user part).
SHORT_EDIT_SYSTEM = """Rolün: Türkçe içerik editörü (E-E-A-T & semantik SEO).
Kurallar:
- Anlamı koru, yeni bilgi uydurma, CTA/pazarlama ekleme.
- h1/h2: Tek cümle, nokta yok; soruysa "?".
- li: Tek cümle, sonda nokta.
- p/div: En fazla 2 kısa cümle.
- Niyet terimi: Sorgudaki ana terim en az 1 kez birebir geçsin.
- SADECE geçerli JSON döndür.
JSON Şema:
{
  "kullanici_sorgusu": "...",
  "eski_metin": "...",
  "kisa_duzenleme": "..."
}"""
SHORT_EDIT_USER = """Kullanıcı Sorgusu: {kullanici_sorgusu}
Eski Metin: {eski_metin}
HTML Bölümü: {html_bolumu}
Eski Skor: {eski_skor}

Lütfen SADECE geçerli bir JSON döndür."""
SHORT_EDIT_TEMPLATE = "<|system|>\n" + SHORT_EDIT_SYSTEM.replace("{", "{{").replace("}", "}}") \
    + "\n<|user|>\n" + SHORT_EDIT_USER


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ("lit", text) and ("var", name) parts; ``{{``
    and ``}}`` are literal braces."""
    parts, pos = [], 0
    t = template.replace("{{", "\x00").replace("}}", "\x01")
    for m in _PLACEHOLDER.finditer(t):
        if m.start() > pos:
            parts.append(("lit", t[pos:m.start()]))
        parts.append(("var", m.group(1)))
        pos = m.end()
    if pos < len(t):
        parts.append(("lit", t[pos:]))
    return [(k, v.replace("\x00", "{").replace("\x01", "}")) if k == "lit" else (k, v) for k, v in parts]


def render(template: str, values: dict) -> Column:
    """The template with each placeholder replaced by a column
    (strings as is, numbers as their text)."""
    cols = []
    for kind, v in template_parts(template):
        if kind == "lit":
            cols.append(F.lit(v))
        else:
            c = values[v]
            c = F.col(c) if isinstance(c, str) else c
            cols.append(F.coalesce(c.cast("string"), F.lit("None")))
    return F.concat(*cols)

# --- fixed values: X2, the intent-improvement request -------------------------
# Rendered as a chat transcript: "System: <system>\nHuman: <human>".
IMPROVE_SYSTEM = """
Sen bir SEO ve içerik geliştirme uzmanısın.
Görevin, kullanıcı niyetine (intent) göre mevcut metni küçük dokunuşlarla iyileştirmektir.

Kurallar:
1. Benzerlik skorunu artırmaya odaklan, anlamı bozma.
2. Metin türüne göre:
   - h1/h2: Kullanıcı niyetinden DOĞRUDAN başlık üret (örn: "google reklam verme nasıl" → "Google Reklam Verme Nasıl Yapılır?").
   - p/div: Mevcut metni TAMAMEN KORU, sadece kullanıcı niyetini karşılayacak şekilde en fazla 5-10 kelime ekle. Örneğin:
     * Mevcut: "Google reklamları hızlı ve pratiktir."
     * Niyet: "google reklam verme nasıl"
     * Geliştirilmiş: "Google reklamları hızlı ve pratiktir; google reklam verme nasıl yapılır sorusuna kısa bir yanıt sunar."
   - li: Mevcut metni TAMAMEN KORU, sadece kullanıcı niyetini karşılayacak şekilde en fazla 1-2 kelime ekle.
3. Uzunluk sınırları:
   - p/div: Mevcut metne en fazla 5-10 kelime ekle.
   - li: Mevcut metne en fazla 1-2 kelime ekle.
   - h1/h2: "Nasıl Yapılır?" veya "Kılavuzu" varsa ASLA kesilmez.
4. Her zaman değiştir. Rollback yok.
5. Reklam/CTA/pazarlama ifadeleri kullanma: "hedef kitlenize ulaşın", "kampanyanızı oluşturun", "potansiyel müşteriler" vb. yasak.
6. Cevap her zaman geçerli JSON olmalı.
7. KRİTİK KURAL: Mevcut metin mutlaka korunmalı, sadece küçük eklemeler yapılmalı. Metni kısaltma veya özetleme yapma!
8. ÖNEMLİ: Kullanıcı niyetini doğrudan karşılayan ifadeler ekle (örn: "google reklam verme nasıl" için "nasıl yapılır" ifadesi mutlaka geçmeli).
"""
IMPROVE_HUMAN = """
Girdi:
Kullanıcı Niyeti: "{kullanici_niyeti}"
Mevcut İçerik: "{mevcut_icerik}"
HTML Bölümü: "{html_bolumu}"
Eski Skor: {eski_skor}

Beklenen çıktı formatı (JSON):
{{
  "Kullanıcı Niyeti": "{kullanici_niyeti}",
  "Mevcut İçerik": "{mevcut_icerik}",
  "Geliştirilmiş İçerik": "Buraya geliştirilmiş hali gelecek",
  "HTML Bölümü": "{html_bolumu}"
}}

Sadece bu JSON'u döndür, başka açıklama veya metin ekleme.
"""
IMPROVE_TEMPLATE = "System: " + IMPROVE_SYSTEM + "\nHuman: " + IMPROVE_HUMAN
