"""SQL of this subpackage's queries, where SQL can express them over whole tables."""

from __future__ import annotations

_WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
            with e as (
              select distinct r.id, lower(regexp_replace(w.source, '^[{_WHITE}]+|[{_WHITE}]+$', '', 'g')) as source, r.word_count as words
              from report r join wikipedia w using (article_id)
              where r.word_count > 0 and w.source is not null and r.id is not null
            ), n as (select count(distinct id) as n from e)
            select t.request_id, t.source, t.band
            from sample_targets t, n
            where (select count(distinct e.id) from e where e.source = t.source and e.words between t.min_words and t.max_words)
                < greatest(t.min_rows, (n.n * t.sample_pct // 100) * t.share_pct // 100)""",
        "p3_found": f"select article_id from wikipedia where len(regexp_extract_all(text, '[^{_WHITE}]+')) > 300",
    }
