"""Personal data: patterns propose spans, check digits confirm them, words nearby move the score.

Built-in column functions only. Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the gaps and the
matches alternate, so a running sum of their code-point lengths gives every start. The patterns are written so that Java's
matcher stays linear: a look-behind admits a run's first character only and possessive loops never retry, which leaves
the leftmost non-overlapping matches of the plain pattern as they are.

Base kinds keep every confirmed span. Of the kinds added here (account, insurance, identity and tax numbers with check digits, and secrets) those count whose
score, moved by words nearby, is ``ENOUGH`` or more: a number whose check digit one in 23 passes needs its name nearby.

Null text counts as empty: no spans, zero counts. Repeated rows get equal answers. Texts are read whole. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The proposing patterns, in the order in which kinds are listed.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "nir": r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]|[2-9][0-9]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])",
    "dni": r"(?<![A-Za-z0-9])[0-9]{8}-?[A-HJ-NP-TV-Z](?![A-Za-z0-9])",
    "cpf": r"(?<![0-9])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,72}+|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without a match of this has no span of the kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "nir": "[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2}", "dni": "[0-9]{8}-?[A-Z]", "cpf": r"[0-9]\.[0-9]{3}\.[0-9]{3}-", "secret": "AKIA|ghp_|xox[abp]-|PRIVATE KEY"}
#: Letters of Spanish identity numbers by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Least score of an added kind's span.
ENOUGH = 0.5
#: Score before and weight of words nearby; those words for and against.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "nir": 0.6, "dni": 0.4, "cpf": 0.7, "secret": 0.9}
FOR = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"\b(?:ip|host|server|address|login)\b",
    "card": r"\b(?:card|visa|credit|debit|payment|cvv)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|contact)\b",
    "iban": r"\b(?:iban|account|bank|transfer)\b",
    "nir": r"\b(?:nir|insee|sécurité|sociale|secu)\b",
    "dni": r"\b(?:dni|nif|identidad|documento|identity)\b",
    "cpf": r"\b(?:cpf|cadastro|contribuinte|tax)\b",
    "secret": r"\b(?:key|token|secret|password|credentials?)\b",
}
AGAINST = {
    "email": r"\b(?:example|noreply|no-reply)\b",
    "ip": r"\b(?:version|release|section|build)\b",
    "card": r"\b(?:order|invoice|serial|part|tracking)\b",
    "phone": r"\b(?:isbn|serial|version|order)\b",
    "iban": r"\b(?:serial|version|model)\b",
    "nir": r"\b(?:serial|order|tracking|invoice)\b",
    "dni": r"\b(?:serial|order|part|model)\b",
    "cpf": r"\b(?:serial|order|part|model)\b",
    "secret": r"\b(?:example|sample|dummy)\b",
}
AROUND = 40
_BLOCK = 512


def located(text: Column, pattern: str) -> Column:
    """Every match as ``struct(g, l, v)``: length of the gap before it, its own length, its text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.zip_with(
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
        found,
        lambda g, v: F.struct(F.length(g).cast("long").alias("g"), F.length(v).cast("long").alias("l"), v.alias("v")),
    )


def running(pairs: str) -> Column:
    """``struct(s, e, v)`` of each pair, by a running sum in blocks so that long lists stay far from quadratic."""
    return F.expr(f"""
      flatten(aggregate(
        transform(
          transform(sequence(0, cast((size({pairs}) - 1) div {_BLOCK} as int)), b -> slice({pairs}, b * {_BLOCK} + 1, {_BLOCK})),
          block -> aggregate(block,
            struct(0L as p, cast(array() as array<struct<s:bigint,e:bigint,v:string>>) as o),
            (a, x) -> struct(a.p + x.g + x.l as p,
                             array_append(a.o, struct(a.p + x.g as s, a.p + x.g + x.l as e, x.v as v)) as o))),
        struct(0L as p, cast(array() as array<array<struct<s:bigint,e:bigint,v:string>>>) as o),
        (a, r) -> struct(a.p + r.p as p,
                         array_append(a.o, transform(r.o, x -> struct(x.s + a.p as s, x.e + a.p as e, x.v as v))) as o),
        a -> a.o))""")


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the Luhn check; ``v`` has a digit."""
    d = F.reverse(digits(v))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, d.substr(i, F.lit(1)).cast("int")).otherwise(
            (d.substr(i, F.lit(1)).cast("int") * 2) % 10 + F.floor(d.substr(i, F.lit(1)).cast("int") * 2 / 10).cast("int")
        ),
    )
    return total % 10 == 0


def mod97(v: Column) -> Column:
    """Whether ``v`` without blanks, its first four characters last and letters as 10 to 35, leaves 1 modulo 97."""
    bare = F.regexp_replace(v, " ", "")
    turned = F.concat(bare.substr(F.lit(5), F.length(bare)), bare.substr(1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97),
    )
    return rest == 1


def confirmed(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(v)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(v, " ", "")).between(15, 34), mod97(v)).otherwise(False)
    if kind == "nir":  # the last two digits make the others up to a multiple of 97
        d = digits(v)
        return (d.substr(1, 13).cast("long") + d.substr(14, 2).cast("long")) % 97 == 0
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), (digits(v).cast("int") % 23 + 1).cast("int"), F.lit(1)) == F.substring(v, -1, 1)
    if kind == "cpf":
        d = digits(v)
        digit = lambda i: d.substr(F.lit(i), F.lit(1)).cast("int")
        check = lambda n: sum(((n + 1 - i) * digit(i) for i in range(1, n)), F.lit(0)) * 10 % 11 % 10
        return (check(10) == digit(10)) & (check(11) == digit(11)) & ~d.rlike(r"^([0-9])\1*$")
    return F.lit(True)


def pii_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of struct(start, rank, end, kind, score), by start and then kind as listed.

    Code points, end exclusive; a column of that name is replaced. Base kinds keep every confirmed span whatever its score, the others from ``ENOUGH``.
    """
    docs = docs.drop("pii")
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = list(KINDS)
    df = docs.select(
        "*",
        *(
            F.when(whole.contains("@") if k == "email" else whole.rlike(GUARDS[k]), located(whole, KINDS[k])).alias(f"__m_{k}")
            for k in kinds
        ),
    )
    df = df.select(
        *docs.columns, *(F.when(F.size(f"__m_{k}") > 0, running(f"__m_{k}")).alias(f"__s_{k}") for k in kinds)
    )

    def scored(k: str) -> Column:
        def one(x: Column) -> Column:
            left = F.greatest(x["s"] - AROUND, F.lit(0))
            near = F.lower(
                F.concat_ws(" ", whole.substr((left + 1).cast("int"), (x["s"] - left).cast("int")), whole.substr((x["e"] + 1).cast("int"), F.lit(AROUND)))
            )
            moved = F.lit(SCORES[k]) + F.when(near.rlike(FOR[k]), 0.1).otherwise(0.0) - F.when(near.rlike(AGAINST[k]), 0.3).otherwise(0.0)
            return F.struct(
                x["s"].alias("start"), F.lit(kinds.index(k)).alias("rank"), x["e"].alias("end"), F.lit(k).alias("kind"), F.round(moved, 2).alias("score")
            )

        kept = F.transform(F.filter(F.col(f"__s_{k}"), lambda x: confirmed(k, x["v"])), one)
        kept = kept if k in BASE else F.filter(kept, lambda x: x["score"] >= ENOUGH)
        return F.coalesce(kept, F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double>>)"))

    return df.select(*docs.columns, F.array_sort(F.concat(*(scored(k) for k in kinds))).alias("pii"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of ``pii_spans``' result."""
    named = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    pii = F.col("pii")
    counted = lambda k: F.size(F.filter(pii, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(counted(k) for k in KINDS),
        F.sha2(named(F.filter(pii, lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        named(pii).alias("spans"),
        F.array_join(F.transform(pii, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
