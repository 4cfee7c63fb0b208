"""URL filter: host and path rules, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms in one pass over host and path.  A hit counts only
if no letter or digit touches it.  One strict term rejects, and so do `soft_hits` different
soft terms.  Both lists are parameters.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended

#: Terms of which one rejects: pornography, gambling, drugs without prescription, pirated and
#: forged goods, in English, German, Spanish and French.
STRICT = tuple(
    """
    adult bets casino escort hentai nude pills porn porno sex spam viagra xxx
    pornography camgirl camgirls milf blowjob erotic erotica fetish hardcore stripper striptease webcamsex sexcam
    poker roulette slots sportsbook betting gambling blackjack bookmaker cialis levitra steroids xanax oxycontin
    warez torrent torrents keygen nulled counterfeit darknet
    erotik nackt hure huren nutten sexkontakte gluecksspiel sportwetten spielautomaten
    desnuda desnudas putas prostitutas erotico sexo apuestas tragamonedas ruleta falsificado
    salope salopes pute putes erotique sexe paris-sportifs machines-a-sous contrefacon
    """.split()
)
#: Terms of which several different ones reject: selling, lures, tracking, farms of links.
SOFT = tuple(
    """
    ads bet bonus cheap click coupon download farm free lottery loan popup promo track win
    affiliate bargain buy cash clickbait deal deals discount earn giveaway hot jackpot marketing payday prize sale sponsored survey unlimited
    gratis billig gewinn gewinnspiel gutschein kredit rabatt verdienen werbung
    barato descuento dinero ganar oferta ofertas premio prestamo publicidad sorteo
    argent concours gagner gratuit pas-cher prix promotion pub reduction soldes
    """.split()
)

#: (host, path, verdict): holds for the host and its subdomains, longest fit first.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as in the module's rules; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    has = F.coalesce(at > 0, F.lit(False))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def url_filter(
    pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = 2
) -> DataFrame:
    """Adds host, path, rule (host and path of the longest fitting one, else null), strict
    and soft (the different terms hit, sorted) and verdict (allow or block).

    A rule's length is that of host and path together; equal lengths go to the first listed.
    A null url or one without "://" has empty host and path, no rule and no hits: allow.
    Repeated rows are judged alike; columns of the added names are replaced; empty: empty.
    """
    names = ("host", "path", "rule", "strict", "soft", "verdict")
    host, path = url_parts(F.col(url_col))
    pages = pages.withColumns({"_uf_host": host, "_uf_path": path}).drop(*names).withColumnsRenamed({"_uf_host": "host", "_uf_path": "path"})
    base = pages.columns
    terms = {**dict.fromkeys(soft, 0), **dict.fromkeys(strict, 1)}

    def hits(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        for batch in batches:
            found: tuple[list, list] = [], []
            hosts, paths = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("host", "path"))
            for text in map("".join, zip(hosts, paths, strict=True)):
                text = text.lower()
                own: tuple[set, set] = set(), set()
                for end, (term, weight) in automaton.iter(text) if terms else ():
                    start = end - len(term) + 1
                    if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                        own[weight].add(term)
                for into, x in zip(found, own, strict=True):
                    into.append(sorted(x))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.list_(pa.string())) for x in reversed(found))], names=[*batch.schema.names, "strict", "soft"]
            )

    schema = extended(pages.schema, "strict array<string>, soft array<string>")
    judged = pages.mapInArrow(hits, schema)
    fits = sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))
    rule = verdict = None
    for at, under, word in fits:
        fit = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(under)
        rule = F.when(fit, at + under) if rule is None else rule.when(fit, at + under)
        verdict = F.when(fit, word) if verdict is None else verdict.when(fit, word)
    own = F.when((F.size("strict") > 0) | (F.size("soft") >= soft_hits), "block").otherwise("allow")
    rule = F.lit(None).cast("string") if rule is None else rule
    return judged.select(*base, rule.alias("rule"), "strict", "soft", (own if verdict is None else F.coalesce(verdict, own)).alias("verdict"))
