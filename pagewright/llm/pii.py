"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text in a single pass: the
at-sign, the scheme mark ``://``, the plus sign, digits, and the cues of secrets
and account numbers.  A small deterministic parser then works outward from each
anchor, finds the bounds of what stands there and checks it.

Kinds, in the order of reports:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds.  What the patterns of
  ``BASE`` match, leftmost and non-overlapping within a kind; a match that fails
  its check (parts over 255, digits, Luhn) is used up and dropped.
* ``url``: the user part of a URL, ``user:password`` before the at-sign.
* ``secret``: the value after ``token =``, ``password:`` and the like; eight
  characters at least, a digit among them.
* ``account``: an IBAN after its cue, with the right check digits, a social
  security number after its cue, or 6 to 17 digits after an account's cue.
"""

from __future__ import annotations

import re
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone", "url", "secret", "account")
#: The base kinds as regular expressions; the parsers below agree with them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key")
ACCOUNT_CUES = ("iban", "ssn", "social security number")
NUMBER_CUES = ("account number", "account no", "acct no")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(BASE["ip"])
CHAIN = re.compile(BASE["card"])
PHONE = re.compile(BASE["phone"])
USER = re.compile(r"[^\x09-\x0D\x20/?#@:\"'<>]+:[^\x09-\x0D\x20/?#@\"'<>]+(?=@)")
VALUE = re.compile(r"[\x20\t]*[:=][\x20\t]*([\"']?)([A-Za-z0-9_.~+/=-]{8,})\1")
IBAN = re.compile(r"[\x20\t]*[:=#]?[\x20\t]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){2,8})(?![A-Za-z0-9])")
SSN = re.compile(r"[\x20\t]*[:=#]?[\x20\t]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
NUMBER = re.compile(r"\.?[\x20\t]*(?:[:=#]|is\b)?[\x20\t]*([0-9](?:[\x20-]?[0-9]){5,16})(?![A-Za-z0-9]|[\x20-][0-9])")
DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def forms(cues: tuple[str, ...]) -> list[str]:
    """The cues in small letters, in capitals, and with the first or every word capitalised."""
    return sorted({f for c in cues for f in (c, c.upper(), c.capitalize(), c.title())})


def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", 1))
    a.add_word("://", (":", 3))
    for kind, cues in (("s", SECRET_CUES), ("a", ACCOUNT_CUES), ("n", NUMBER_CUES)):
        for form in forms(cues):
            a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """kind -> (start, end) spans by start, in code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {}
    email_end = ip_end = card_end = phone_end = digit_end = 0
    for last, (kind, size) in automaton.iter(text):
        if kind == "0":
            # the first digit of a run decides for the run; a chain or quad may span several runs
            if last >= digit_end:
                at = last
                digit_end = at + 1
                while digit_end < len(text) and text[digit_end] in DIGITS:
                    digit_end += 1
                if at >= ip_end and digit_end < len(text) and text[digit_end] == "." and (m := QUAD.match(text, at)):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                        out.setdefault("ip", []).append((at, ip_end))
                if at >= card_end and (m := CHAIN.match(text, at)):
                    card_end = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.setdefault("card", []).append((at, card_end))
        elif kind == "@":
            at = last
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.setdefault("email", []).append((start, email_end))
        elif kind == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out.setdefault("phone", []).append((last, phone_end))
        elif kind == ":":
            if m := USER.match(text, last + 1):
                out.setdefault("url", []).append(m.span())
        else:
            first, end = last + 1 - size, last + 1
            if first and (text[first - 1].isalnum() or text[first - 1] == "_"):
                continue
            if kind == "s":
                if (m := VALUE.match(text, end)) and any(c in DIGITS for c in m.group(2)):
                    _add(out, "secret", m.span(2))
            elif (m := IBAN.match(text, end)) and iban(m.group(1)):
                _add(out, "account", m.span(1))
            elif (m := SSN.match(text, end)) or (kind == "n" and (m := NUMBER.match(text, end))):
                _add(out, "account", m.span(1))
    return out


def _add(out: dict[str, list[tuple[int, int]]], kind: str, span: tuple[int, int]) -> None:
    spans = out.setdefault(kind, [])
    if not spans or spans[-1][1] <= span[0]:
        spans.append(span)


def written(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found.get(k, ()))


REPORT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
NOTHING = sha256(b"").hexdigest()


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document with its counts and spans; ``n_spans`` counts those of all kinds.

    A null text counts as empty: no spans.  Repeated rows stay repeated; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch, automaton) -> pa.RecordBatch:
        counts: list[list[int]] = [[], [], [], []]
        digest, spans, all_spans = [], [], []
        for t in batch.column(1).to_pylist():
            found = find(t, automaton) if t else {}
            for c, k in zip(counts, KINDS, strict=False):
                c.append(len(found.get(k, ())))
            digest.append(sha256(base.encode()).hexdigest() if (base := written(found, KINDS[:4])) else NOTHING)
            spans.append(written(found) if found else "")
            all_spans.append(sum(map(len, found.values())))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(all_spans, pa.int64())],
            names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, "text"), run, f"`{id_col}` {kind}, {REPORT}", setup=anchors)


def mask(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, of the first kind listed."""
    spans = sorted((s, e, KINDS.index(k)) for k, each in found.items() for s, e in each)
    out, done, i = [], 0, 0
    while i < len(spans):
        s, e, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e, k = max(e, spans[i][1]), min(k, spans[i][2])
            i += 1
        out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = e
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; same rows and columns.

    ``n_chars``, if there, is counted anew for changed texts.  Null and empty
    texts stay as they are.
    """
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch, automaton) -> pa.RecordBatch:
        texts, changed = batch.column(at).to_pylist(), {}
        for i, t in enumerate(texts):
            if t and (found := find(t, automaton)):
                changed[i] = texts[i] = mask(t, found)
        if not changed:
            return batch
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        if "n_chars" in names:
            k = names.index("n_chars")
            counts = batch.column(k).to_pylist()
            for i, t in changed.items():
                counts[i] = len(t)
            batch = batch.set_column(k, batch.schema.field(k), pa.array(counts, batch.schema.field(k).type))
        return batch

    return map_batches(docs, run, docs.schema, setup=anchors)


def sql() -> str:
    """The rows of ``report`` in DuckDB SQL, over the view ``documents``: whole-text patterns; what stands before each match gives its place."""
    edge, sep = r"(?:^|[^\p{L}\p{N}_])", r"[\x20\t]*[:=#]?[\x20\t]*"
    value, one_of = r"[A-Za-z0-9_.~+/=-]{8,}", lambda cues: "(?:" + "|".join(forms(cues)) + ")"
    user = r"""[^\x09-\x0D\x20/?#@:"'<>]+:[^\x09-\x0D\x20/?#@"'<>]+"""
    # (kind, what leads up to the span, span, what has to follow)
    patterns = [
        *((k, "", re.sub(r"\((?=\\|\[)", "(?:", BASE[k]), "") for k in KINDS[:4]),
        ("url", "://", user, "@"),
        ("secret", f"{edge}{one_of(SECRET_CUES)}[\\x20\\t]*[:=][\\x20\\t]*\"", value, '"'),
        ("secret", f"{edge}{one_of(SECRET_CUES)}[\\x20\\t]*[:=][\\x20\\t]*'", value, "'"),
        ("secret", f"{edge}{one_of(SECRET_CUES)}[\\x20\\t]*[:=][\\x20\\t]*", value, ""),
        ("iban", f"{edge}{one_of((*ACCOUNT_CUES, *NUMBER_CUES))}{sep}", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){2,8}", r"(?:[^A-Za-z0-9]|$)"),
        ("account", f"{edge}{one_of((*ACCOUNT_CUES, *NUMBER_CUES))}{sep}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?:[^0-9-]|$)"),
        ("account", f"{edge}{one_of(NUMBER_CUES)}\\.?[\\x20\\t]*(?:[:=#]|is\\b)?[\\x20\\t]*", r"[0-9](?:[\x20-]?[0-9]){5,16}", r"(?:$|[^A-Za-z0-9\x20-]|[\x20-](?:$|[^0-9]))"),
    ]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for n, (kind, lead, span, follow) in enumerate(patterns):
        whole = quoted(f"(?s)(.*?{lead})({span})({follow})")
        parts.append(f"select r, {n} as pattern, '{kind}' as kind, generate_subscripts(regexp_extract_all(t, {whole}, 2), 1) as i, unnest(regexp_extract_all(t, {whole}, 1)) as lead, unnest(regexp_extract_all(t, {whole}, 2)) as hit, unnest(regexp_extract_all(t, {whole}, 3)) as follow from d")
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: case when i % 2 = 0 then substr(reverse({digits}), i + 1, 1)::int when substr(reverse({digits}), i + 1, 1)::int < 5 then 2 * substr(reverse({digits}), i + 1, 1)::int else 2 * substr(reverse({digits}), i + 1, 1)::int - 9 end)) % 10 = 0"
    bare = "replace(hit, ' ', '')"
    turned = f"substr({bare}, 5) || substr({bare}, 1, 4)"
    modulo = f"list_reduce(list_prepend(0, list_transform(string_split({turned}, ''), lambda c: case when c >= 'A' then ascii(c) - 55 else c::int end)), lambda a, v: (a * (case when v > 9 then 100 else 10 end) + v) % 97) = 1"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
placed as (select r, kind, hit, (sum(length(lead) + length(hit) + length(follow)) over (partition by r, pattern order by i) - length(hit) - length(follow))::bigint as s from m),
good as (select distinct r, case kind when 'iban' then 'account' else kind end as kind, s, s + length(hit) as e from placed where case kind
 when 'ip' then len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 or right('000' || x, 3)::int > 255)) = 0
 when 'card' then length({digits}) between 16 and 19 and {luhn}
 when 'phone' then length({digits}) between 8 and 15
 when 'secret' then regexp_matches(hit, '[0-9]')
 when 'iban' then length({bare}) between 15 and 34 and {modulo} else true end),
ranked as (select r, kind, s, e, list_position({list(KINDS)!r}, kind) as k from good),
joined as (select r, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in KINDS[:4])}, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) filter (k <= 4) as base, string_agg(kind || ':' || s || ':' || e, ',' order by k, s) as spans, count(*) as n_spans from ranked group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in KINDS[:4])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0)::bigint as n_spans from d left join joined using (r)
"""
