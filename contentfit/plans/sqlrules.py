"""DuckDB SQL twins of :mod:`contentfit.functions.rules` for the oracle.

``let`` binds an expression once (a one-element ``list_transform``), so a
rule that reads its input several times does not copy the input's SQL text.
"""

from __future__ import annotations

import itertools

from contentfit.functions import rules as R
from contentfit.plans import sqlfn as q
from contentfit.plans.sqlfn import WS_CLASS

_ids = itertools.count()


def let(x: str, body) -> str:
    v = f"v{next(_ids)}"
    return f"(list_transform([{x}], lambda {v}: {body(v)})[1])"


def _re2(p: str) -> str:
    """Java ``(?iu)`` -> RE2 ``(?i)`` (RE2 folding is Unicode already)."""
    return p.replace("(?iu)", "(?i)")


def qnorm(x: str) -> str:
    return f"lower({_norm(x)})"


def _norm(x: str) -> str:
    return q.normalize_ws(f"coalesce({x}, '')")


def _any_contains(L: str, stems) -> str:
    return "(" + " OR ".join(f"contains({L}, {q.lit(s)})" for s in stems) + ")" if stems else "false"


def title_case(x: str, pack: R.RulePack) -> str:
    small = ", ".join(q.lit(w) for w in pack.small_words if " " not in w)
    return (f"array_to_string(list_transform(string_split({_norm(x)}, ' '), lambda w, i: "
            f"CASE WHEN i > 1 AND lower(w) IN ({small}) THEN lower(w) "
            f"ELSE (CASE WHEN left(w, 1) = 'ß' THEN 'Ss' ELSE upper(left(w, 1)) END) "
            f"|| lower(substr(w, 2)) END), ' ')")


def finalize(x: str, tag: str, pack: R.RulePack) -> str:
    heads = ", ".join(q.lit(h) for h in pack.dispatch_heading)

    def body(t0):
        t1 = q.rx_replace(t0, r"^[ ,;:\-]+|[ ,;:\-]+$", "")
        t2 = q.strip_ws(q.rx_replace(t1, _re2(R._tails_re(pack)), ""))
        return let(t2, lambda t: (f"CASE WHEN lower({tag}) IN ({heads}) THEN {t} "
                                  f"WHEN regexp_matches({t}, '[.!?]$') THEN {t} ELSE {t} || '.' END"))
    return let(_norm(x), body)


def enforce_budget(original: str, cand: str, tag: str, pack: R.RulePack) -> str:
    heads = ", ".join(q.lit(h) for h in pack.dispatch_heading)

    def with_o(o):
        def with_c(c):
            n = f"(CASE WHEN {o} = '' THEN 0 ELSE len(string_split({o}, ' ')) END)"
            keep = " OR ".join(f"ends_with({c}, {q.lit(s)})" for s in pack.keep_suffixes) or "false"
            cut = lambda b: f"array_to_string(string_split({c}, ' ')[1:{b}], ' ')"
            head_b = f"greatest({n} + 4, ({n} * 18) // 10)"
            other_b = f"(CASE WHEN {n} >= 10 THEN ({n} * 11) // 10 ELSE {n} + 1 END)"
            return (f"CASE WHEN {n} = 0 OR {c} = '' THEN {cand} "
                    f"WHEN lower({tag}) IN ({heads}) THEN (CASE WHEN {keep} THEN {c} ELSE {cut(head_b)} END) "
                    f"WHEN lower({tag}) = 'li' THEN {cut(f'{n} + 1')} ELSE {cut(other_b)} END")
        return let(_norm(cand), with_c)
    return let(_norm(original), with_o)


def scrub_phrases(x: str, pack: R.RulePack) -> str:
    t = _norm(x)
    for b in pack.banned:
        t = q.strip_ws(q.rx_replace(t, "(?i)" + R.quote_re(b), ""))
    return q.rx_replace(t, WS_CLASS + "{2,}", " ")


def replace_first(t: str, rule: R.MicroRule) -> str:
    pat = ("(?s)^(.*?" + (R.LEFT_EDGE if rule.left else "") + ")(?:" + rule.pattern + ")("
           + (R.RIGHT_EDGE if rule.right else "") + ".*)$")
    repl = rule.repl.replace("\\", "\\\\")
    return f"regexp_replace({t}, {q.lit(pat)}, {q.lit(chr(92) + '1' + repl + chr(92) + '2')})"


def micro_edit(x: str, pack: R.RulePack) -> str:
    def body(t):
        arms = " ".join(f"WHEN {replace_first(t, r)} <> {t} THEN {replace_first(t, r)}"
                        for r in pack.micro_rules)
        return f"(CASE {arms} ELSE {t} END)"
    return scrub_phrases(let(_norm(x), body), pack)


def base_from_query(L: str, pack: R.RulePack) -> str:
    arms = " ".join(f"WHEN {_any_contains(L, stems)} THEN {title_case(q.lit(phrase), pack)}"
                    for stems, phrase in pack.base_rules)
    return f"(CASE {arms} ELSE {title_case(L, pack)} END)"


def heading_from_query(L: str, pack: R.RulePack) -> str:
    how = f"(regexp_matches({L}, {q.lit(R.bounded(R.quote_re(pack.how_word)))}) OR {_any_contains(L, pack.how_stems)})"
    base = base_from_query(L, pack)
    return (f"(CASE WHEN {how} THEN {base} || {q.lit(pack.how_suffix)} "
            f"WHEN regexp_matches({L}, {q.lit(pack.guide_re)}) THEN {base} || {q.lit(pack.guide_suffix)} "
            f"ELSE {title_case(L, pack)} END)")


def summary_from_old(cur: str, L: str, pack: R.RulePack) -> str:
    def body(t):
        search = f"regexp_matches({t}, {q.lit('(?i)' + pack.flag_search)})"
        cpc = f"regexp_matches({t}, {q.lit('(?i)(?:' + pack.flag_cpc + ')')})"
        plat = f"regexp_matches({t}, {q.lit('(?i)' + pack.flag_platform)})"
        first = f"(CASE WHEN {cpc} OR {plat} THEN {q.lit(pack.summary_cpc)} ELSE {q.lit(pack.summary_basic)} END)"
        fam_a = f"({first} || CASE WHEN {search} THEN ', ' || {q.lit(pack.summary_search)} ELSE '' END || '.')"
        return (f"(CASE WHEN {_any_contains(L, pack.summary_stems_a)} THEN {fam_a} "
                f"WHEN {_any_contains(L, pack.summary_stems_b)} THEN {q.lit(pack.summary_b)} "
                f"ELSE {q.lit(pack.summary_default)} END)")
    sent = let(_norm(cur), body)
    return finalize(micro_edit(sent, pack), "'div'", pack)


def li_from_query(L: str, original: str, pack: R.RulePack) -> str:
    def body(o):
        base = f"(CASE WHEN {o} = '' THEN {title_case(L, pack)} ELSE {o} END)"
        arms = " ".join(f"WHEN contains({L}, {q.lit(stem)}) THEN {q.lit(sent)}" for stem, sent in pack.li_rules)
        return f"(CASE {arms} ELSE {base} || {q.lit(pack.li_suffix)} END)"
    return finalize(let(_norm(original), body), "'li'", pack)


def short_answer(L: str, tag: str, pack: R.RulePack) -> str:
    arms = " ".join(f"WHEN contains({L}, {q.lit(stem)}) THEN {q.lit(sent)}" for stem, sent in pack.short_rules)
    how = f"regexp_matches({L}, {q.lit(R.bounded(R.quote_re(pack.how_word)))})"
    body = (f"(CASE {arms} WHEN {how} THEN {base_from_query(L, pack)} || {q.lit(pack.short_how_suffix)} "
            f"ELSE {title_case(L, pack)} END)")
    return finalize(body, tag, pack)


def rule_candidate(cur: str, L: str, tag: str, pack: R.RulePack) -> str:
    tg = f"lower(coalesce({tag}, ''))"
    inn = lambda xs: ", ".join(q.lit(x) for x in xs)
    return (f"(CASE WHEN {tg} IN ({inn(pack.dispatch_heading)}) THEN {heading_from_query(L, pack)} "
            f"WHEN {tg} IN ({inn(pack.dispatch_summary)}) THEN {summary_from_old(cur, L, pack)} "
            f"WHEN {tg} IN ({inn(pack.dispatch_li)}) THEN {li_from_query(L, cur, pack)} "
            f"ELSE {micro_edit(cur, pack)} END)")
