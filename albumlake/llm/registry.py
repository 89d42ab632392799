"""The dealt operators' queries and their SQL."""

from __future__ import annotations

from . import audit, htmltree, jaccard, langid, media, mixing, order, quality, repair, toxicity, urls, wfst, winnow

QUERIES = {
    "op1_audio": media.op1_audio,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_sentencepiece": wfst.op6_sentencepiece,
    "op7_training_order": order.op7_training_order,
    "op8_url_filter": urls.op8_url_filter,
    "op9_html_extraction": htmltree.op9_html_extraction,
    "op10_language_id": langid.op10_language_id,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_decontamination": winnow.op12_decontamination,
    "op13_filter_audit": audit.op13_filter_audit,
}


def _url_sql() -> str:
    strict = " or ".join(f"regexp_matches(lower(url), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')" for t in urls.STRICT)
    soft = " + ".join(f"cast(regexp_matches(lower(url), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') as int)" for t in urls.SOFT)
    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for h, p, _ in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in urls.RULES)
    return f"""
with u as (select page_id, coalesce(url, '') url from pages),
p as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from u),
h as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r as (select *, case {cases} end rule, ({strict}) bad, ({soft}) n_soft from h)
select page_id, host, path, rule,
  coalesce(case rule {verdicts} end, case when bad or n_soft >= {urls.SOFT_LIMIT} then 'block' else 'allow' end) verdict from r"""


SQL = {"op8_url_filter": _url_sql(), "op12_decontamination": winnow.SQL, "op13_filter_audit": audit.SQL}
