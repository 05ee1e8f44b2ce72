"""Defaults shared by the jobs.  All are arguments of the functions that use
them; these are only the values used when the caller passes nothing."""

# --- fixed values (must equal the reference's behaviour) -------------------
# Score cut between the two verdicts, the improvement band (both ends
# inclusive) and the minimum percent change that counts as an improvement.
VERDICT_CUT = 0.65
BAND_LOW = 0.65
BAND_HIGH = 0.85
DELTA_MIN = 0.001
# Generation limits of the intent improver: attempts per row, tries per attempt.
MAX_ATTEMPTS = 3
MAX_TRIES = 5
# Priority query list: top k by clicks and top k by impressions.
TOP_K = 5
# Default verdict labels; the reference's own labels are kept as a pack.
VERDICT_LABELS = ("fit", "low_fit")
VERDICT_LABELS_ORIGINAL = ("Uyumlu", "Düşük Uyum")
# Percent change denominator floor.
PCT_EPS = 1e-8

# --- engineering bounds (ours) ---------------------------------------------
# Largest side, in rows and in bytes, that is ever broadcast.  Above it the jobs switch to
# bounded broadcast chunks or a salted shuffle join.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20
# Salt buckets for shuffle joins on skewed keys (tokens).
SALT_BUCKETS = 32
# A table of fewer bytes a core is dealt over all cores before per-row work.
SPREAD_BYTES = 16 << 20
