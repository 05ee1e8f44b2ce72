"""Reading and writing tables with the reference's column names.

Files produced for (or by) the reference keep their Turkish headers; these
helpers rename columns on the way in and lay tables out in the reference's
column order and verdict labels on the way out.  Renames only: no data
passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit import config

# --- fixed values: reference column names -> ours --------------------------
TO_OURS = {
    "Sorgu": "query", "Kullanıcı Sorgusu": "query", "En çok yapılan sorgular": "query",
    "Tıklamalar": "clicks", "Gösterimler": "impressions",
    "Kısa Niyet Teması": "intent", "Kullanıcı Niyeti": "intent",
    "HTML Bölümü": "section", "Alan": "field",
    "İçerik": "text", "Metin": "text",
    "Mevcut İçerik": "old_text", "Eski Metin": "old_text",
    "Geliştirilmiş İçerik": "new_text", "Geliştirilmiş Metin": "new_text",
    "Benzerlik Skoru": "score", "Eski Skor": "old_score", "Yeni Skor": "new_score",
    "Yüzde Değişim": "pct_change", "Uyum Durumu": "verdict",
    "Title": "title", "Meta Description": "meta_description",
}

# Output layouts: (our column, reference header) in the reference's order.
LAYOUTS = {
    "query_intent": (("query", "Sorgu"), ("intent", "Kısa Niyet Teması")),
    "section_intent_fit": (("section", "HTML Bölümü"), ("text", "İçerik"), ("intent", "Kullanıcı Niyeti"),
                           ("score", "Benzerlik Skoru"), ("verdict", "Uyum Durumu")),
    "section_query_fit": (("section", "HTML Bölümü"), ("text", "İçerik"), ("query", "Kullanıcı Sorgusu"),
                          ("score", "Benzerlik Skoru"), ("verdict", "Uyum Durumu")),
    "field_fit": (("field", "Alan"), ("text", "Metin"), ("query", "Kullanıcı Sorgusu"),
                  ("score", "Benzerlik Skoru"), ("verdict", "Uyum Durumu")),
    "self_fit": (("title", "Title"), ("meta_description", "Meta Description"),
                 ("score", "Benzerlik Skoru"), ("verdict", "Uyum Durumu")),
    "intent_improvement": (("intent", "Kullanıcı Niyeti"), ("old_text", "Mevcut İçerik"),
                           ("new_text", "Geliştirilmiş İçerik"), ("section", "HTML Bölümü"),
                           ("old_score", "Eski Skor"), ("new_score", "Yeni Skor"),
                           ("pct_change", "Yüzde Değişim")),
    "query_improvement": (("section", "HTML Bölümü"), ("query", "Kullanıcı Sorgusu"),
                          ("old_text", "Eski Metin"), ("new_text", "Geliştirilmiş Metin"),
                          ("old_score", "Eski Skor"), ("new_score", "Yeni Skor"),
                          ("pct_change", "Yüzde Değişim")),
}


def _relabel(c, src, dst):
    out = c
    for a, b in zip(src, dst):
        out = F.when(c == a, F.lit(b)).otherwise(out)
    return out


def from_reference(df: DataFrame) -> DataFrame:
    """Rename the reference's headers to ours (unknown columns kept) and map
    its verdict labels to ours."""
    for name in df.columns:
        if name in TO_OURS:
            df = df.withColumnRenamed(name, TO_OURS[name])
    if "verdict" in df.columns:
        df = df.withColumn("verdict", _relabel(F.col("verdict"), config.VERDICT_LABELS_ORIGINAL,
                                               config.VERDICT_LABELS))
    return df


def to_reference(df: DataFrame, layout: str, original_labels: bool = True) -> DataFrame:
    """Select a table in the reference's column order and headers."""
    cols = []
    for ours, theirs in LAYOUTS[layout]:
        c = F.col(ours)
        if ours == "verdict" and original_labels:
            c = _relabel(c, config.VERDICT_LABELS, config.VERDICT_LABELS_ORIGINAL)
        cols.append(c.alias(theirs))
    return df.select(*cols)
