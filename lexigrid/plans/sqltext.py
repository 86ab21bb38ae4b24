"""Parts of SQL that several queries' oracles share."""

from __future__ import annotations

import functools
import unicodedata

#: Characters whose compatibility form has several characters: fractions, digraphs, marks, numerals, ligatures.
_LONG = [*range(0xBC, 0xBF), *range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), 0x2116, *range(0x2120, 0x2123), *range(0x2150, 0x2180), *range(0x2460, 0x2474), *range(0xFB00, 0xFB07)]


@functools.cache
def _single() -> tuple[str, str]:
    """Characters that compatibility folding turns into one other letter or number, and those."""
    pairs = []
    for k in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(k)
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and folded != unicodedata.normalize("NFC", c) and folded.isalnum():
            pairs.append((c, folded))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def nfkc(x: str) -> str:
    """Compatibility form of a text, as far as letters and numbers go."""
    inner = x
    for k in _LONG:
        folded = unicodedata.normalize("NFKC", chr(k))
        if len(folded) > 1:
            inner = f"replace({inner}, '{chr(k)}', '{folded}')"
    source, target = _single()
    return f"nfc_normalize(translate({inner}, '{source}', '{target}'))"


@functools.cache
def key(x: str) -> str:
    """Comparison key of a title or passage."""
    folded = f"case when regexp_matches({x}, '[^\\x00-\\x7f]') then {nfkc(x)} else {x} end"
    return rf"trim(regexp_replace(lower({folded}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_B = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _bare(x: str) -> str:
    return f"""regexp_replace(regexp_replace({x}, '^[{_B}]*"*[{_B}]*', ''), '[{_B}]*"*[{_B}]*$', '')"""


def _tail(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(?:<\\|COMPLETE\\|>|[#*)>{_B}])+$', ''), '^[{_B}]+', '')"


_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

#: Tuple records of raw answers: ``ent`` (label_id, pos, title, type, description) and ``rel`` (label_id, pos, source, target, description, strength).
RECORDS = rf"""cut as (select label_id, list_filter(string_split(regexp_replace(teacher_raw, '(\("(?:entity|relationship)"<\|>)', chr(1) || '\1', 'g'), chr(1)),
    lambda y: starts_with(y, '("entity"<|>') or starts_with(y, '("relationship"<|>')) as rs from report where contains(teacher_raw, '<|>')),
  one as (select label_id, unnest(rs) as r, generate_subscripts(rs, 1) as pos from cut),
  fld as (select label_id, pos, starts_with(r, '("entity"') as e, list_transform(string_split(regexp_replace(r, '^\("(?:entity|relationship)"<\|>', ''), '<|>'), lambda y: {_bare('y')}) as f from one),
  ent0 as (select label_id, pos, f[1] as title, f[2] as type, {_tail("array_to_string(f[3:], '<|>')")} as description from fld where e and len(f) >= 2 and f[1] <> '' and f[2] <> ''),
  num as (select label_id, pos, f, {_tail('f[len(f)]')} as last from fld where not e and len(f) >= 3 and f[1] <> '' and f[2] <> ''),
  ent as (select label_id, row_number() over (partition by label_id order by pos) - 1 as pos, title, type, description from ent0),
  rel as (select label_id, row_number() over (partition by label_id order by pos) - 1 as pos, f[1] as source, f[2] as target,
    {_tail("array_to_string(case when len(f) >= 4 and regexp_matches(last, '" + _NUMBER + "') then f[3:len(f) - 1] else f[3:] end, '<|>')")} as description,
    case when len(f) >= 4 and regexp_matches(last, '{_NUMBER}') then greatest(0.0::double, least(10.0::double, last::double)) else 1.0::double end as strength
    from num where label_id in (select label_id from ent))"""
