"""Personal data by weak supervision.

Candidate spans come from the base patterns (kept always) and from looser ones, which look for the same kinds and for
secrets, bank accounts, identity numbers, names and street addresses. Five labelers vote on each candidate (yes, no, or
nothing): its form (a stricter pattern), its inner checks (check digits, ranges, mixture of characters), a gazetteer
(domains, country codes, card issuers, key prefixes, given names, street words), the words before it, and those after it.

Expectation-maximisation estimates each labeler's reliability for each kind, without labels, from the counts of all vote
patterns in the corpus. The probabilities that it gives train a logistic span classifier. Its features are not the votes:
the span's shape, length and characters, its checks, and the words around it, hashed to FEATURES places. The classifier
decides which of the looser candidates are added.

What reaches the driver is a count for each vote pattern (at most 9 x 3^5 x 2 rows for any corpus), and the features, no
text, of at most MAX_FIT candidates, those of least hash: a documented bound on what the classifier is fitted to.

All scanning is linear in the text: a run of characters is entered at its start only.

Defined cases: a null text is empty and has no spans; offsets count code points; repeated rows give equal results; texts
of any length are read whole; an empty table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone", "secret", "account", "identity", "name", "address")
MAX_FIT, FEATURES, ACCEPT, LABELERS = 20_000, 4096, 0.8, 5

# Base patterns. As far as they could enter a run of characters again at each of its places, they may start there only.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL.pattern)
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Looser forms.
MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}| ?\.[A-Za-z]{2,12}){1,4}")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,2}(?![0-9A-Za-z:])")
LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:[\x20-]?[0-9]{2,6}){2,4}(?![0-9A-Za-z-])")
LOCAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[-. /])[0-9]{3,4}[-. ][0-9]{3,4}(?![0-9A-Za-z.-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]{0,24}[0-9])[A-Za-z0-9_+/=-]{16,256}(?![A-Za-z0-9_+/=-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IDENTITY = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
WORD_UP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}"

# Gazetteers.
DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "us", "ch", "at", "test", "example"}
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "81", "82", "86", "90", "91", "351", "353", "358", "966", "971", "98")
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xox", "eyJ", "AIza", "glpat-", "npm_", "hf_")
BANKS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "SK": 24}
GIVEN = set(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Peter Edward Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Anna Emma Laura Julia "
    "Hans Klaus Jürgen Wolfgang Stefan Andreas Thomas Ursula Sabine Monika Petra Claudia Pierre Jean Michel Philippe Nathalie Isabelle Sophie Camille José Antonio Manuel Carlos Juan Luis María Carmen Ana Isabel Lucía Ahmed Mohammed Ali Fatima".split()
)
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Square".split()
NAME = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\b\.? {WORD_UP}(?: {WORD_UP}){{0,2}}|(?:{'|'.join(sorted(GIVEN))}) {WORD_UP}(?: {WORD_UP})?)(?!\w)")
ADDRESS = re.compile(rf"(?<![0-9A-Za-z.])(?:[0-9]{{1,5}} (?:{WORD_UP} ){{1,3}}(?:{'|'.join(STREETS)})\b\.?|{WORD_UP}(?:straße|strasse|weg|gasse|platz|allee) [0-9]{{1,4}}[a-z]?\b|[0-9]{{1,4}},? (?:rue|avenue|boulevard) (?:(?:de|du|des|la|le) ){{0,2}}{WORD_UP})")
ADDRESS_CUE = re.compile(rf"\b(?:{'|'.join(STREETS)}|rue|avenue|boulevard)\b|(?:straße|strasse|weg|gasse|platz|allee) [0-9]")
CUES = {
    0: "mail contact write address kontakt correo courriel",
    1: "ip host server address login from addr",
    2: "card visa credit payment karte carte tarjeta mastercard debit",
    3: "phone tel call mobile fax telefon téléphone teléfono cell",
    4: "token key secret password passwd pwd apikey auth bearer credential credentials passwort",
    5: "iban account konto compte cuenta bank transfer",
    6: "ssn social security identity passport ausweis id",
    7: "name contact signed by author dear herr frau mr mrs ms dr",
    8: "address lives live street home wohnt adresse dirección at",
}
CUES = {k: set(v.split()) for k, v in CUES.items()}
AGAINST = set("isbn issn version order invoice page doi serial commit revision sha checksum hash md5 build model part figure table section chapter sku".split())
LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def octets(span: str) -> bool:
    """Whether all parts are at most 255; Python reads no number of over 4300 digits, so zeros in front go first."""
    return all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in span.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of EMAIL, each run entered at its start, or where the match before it ended."""
    out, at = [], 0
    m = EMAIL_RUN.search(text)
    while m:
        out.append((m.start(), at := m.end()))
        m = EMAIL.match(text, at) or EMAIL_RUN.search(text, at)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans, none of which overlaps another or one of these; kinds that are told best come first."""
    found = []
    if "[" in text or "(" in text:
        low = text.lower()
        if any(x in low for x in ("[at]", "(at)")):
            found += [(0, m) for m in MASKED.finditer(text)]
    if DIGIT.search(text):
        found += [(5, m) for m in IBAN.finditer(text)]
        if "-" in text:
            found += [(6, m) for m in IDENTITY.finditer(text)]
        if ":" in text:
            found += [(1, m) for m in IP6.finditer(text)]
        found += [(2, m) for m in LONG_NUMBER.finditer(text) if 13 <= len(digits_of(m[0])) <= 19]
        found += [(3, m) for m in LOCAL.finditer(text)]
        found += [(4, m) for m in SECRET.finditer(text) if LETTERS.search(m[0])]
        if ADDRESS_CUE.search(text):
            found += [(8, m) for m in ADDRESS.finditer(text)]
    found += [(7, m) for m in NAME.finditer(text)]
    if not found:
        return []
    # stretches that are taken, apart and in order; a base span of one kind may overlap one of another
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for kind, m in found:
        i = bisect(taken, m.span())
        if (not i or taken[i - 1][1] <= m.start()) and (i == len(taken) or m.end() <= taken[i][0]):
            out.append((kind, m.start(), m.end()))
            taken.insert(i, m.span())
    return out


def checks(kind: int, span: str) -> int:
    """1 if the inner checks of a kind hold, -1 if not, 0 where it has none."""
    d = digits_of(span)
    if kind == 1:
        return 1 if ":" in span or octets(span) else -1
    if kind == 2:
        return 1 if luhn(d) else -1
    if kind == 3:
        return 1 if 7 <= len(d) <= 15 and len(set(d)) > 2 else -1
    if kind == 4:
        # many different characters for its length; words and numbers have few kinds of them in turn
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))
        return 1 if len(set(span)) >= 10 and turns >= 4 else -1
    if kind == 5:
        s = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == 6:
        a, b, c = span.split("-")
        return 1 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -1
    return 0


def around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The last words before a span and the first after it, in lower case."""
    return LETTERS.findall(text[max(0, start - 60) : start].lower())[-6:], LETTERS.findall(text[end : end + 40].lower())[:3]


def votes(kind: int, span: str, before: list[str], after: list[str], base: bool) -> tuple[int, ...]:
    """Of form, checks, gazetteer, words before and words after: 1 yes, -1 no, 0 nothing."""
    d = digits_of(span)
    if kind == 0:
        form, gaz = int(base), 1 if re.split(r"[.\s\])]+", span.lower())[-1] in DOMAINS else -1
    elif kind == 1:
        form, gaz = int(base), -1 if span in ("0.0.0.0", "127.0.0.1", "::1") or d.startswith("0") and "." in span else 0
    elif kind == 2:
        form, gaz = 1 if len(d) in (15, 16) else 0, 1 if d[0] in "3456" else -1
    elif kind == 3:
        form, gaz = 1 if base else int("(" in span), (1 if d.startswith(COUNTRIES) else -1) if span[0] == "+" else 0
    elif kind == 4:
        # hexadecimal of a digest's length, or letters of both cases and digits
        hexadecimal = len(span) in (32, 40, 48, 56, 64) and not set(span.lower()) - set("0123456789abcdef")
        form, gaz = 1 if hexadecimal or (span.lower() != span != span.upper()) else -1, 1 if span.startswith(KEY_HEADS) else 0
    elif kind == 5:
        form, gaz = 1 if len(span.replace(" ", "")) == BANKS.get(span[:2]) else -1, 1 if span[:2] in BANKS else -1
    elif kind == 6:
        form, gaz = 1, 0
    elif kind == 7:
        w = span.replace(".", "").split()
        form, gaz = 1 if len(w) > 1 else 0, 1 if any(x in GIVEN for x in w) else 0
    else:
        form, gaz = 1 if span[0].isdigit() else 0, 1 if any(w.strip(".,") in STREETS for w in span.split()) else 0
    told = lambda words: 1 if any(w in CUES[kind] for w in words) else -1 if any(w in AGAINST for w in words) else 0
    return form, checks(kind, span), gaz, told(before), told(after)


def features(kind: int, span: str, before: list[str], after: list[str]) -> list[int]:
    """Places of a candidate's features: shape, length, characters, checks and words around."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in span))
    own = [f"shape {shape[:12]}", f"length {min(9, len(span).bit_length())}", f"exact {min(99, len(span))}", f"kinds {min(15, len(set(span)) // 2)}", f"digits {8 * len(digits_of(span)) // len(span)}", f"checks {checks(kind, span)}"]
    own += [f"before {w}" for w in before] + [f"next {w}" for w in before[-1:]] + [f"after {w}" for w in after]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % FEATURES for x in ["", *own]})


def pattern(kind: int, vote: tuple[int, ...], base: bool) -> int:
    """Kind, votes and whether the span is of the base, in one small number."""
    out = kind
    for v in vote:
        out = out * 3 + v + 1
    return out * 2 + base


def unpack(p: int) -> tuple[int, tuple[int, ...], bool]:
    p, base = divmod(p, 2)
    v = []
    for _ in range(LABELERS):
        p, x = divmod(p, 3)
        v.append(x - 1)
    return p, tuple(reversed(v)), bool(base)


#: How far each labeler of a kind is trusted before any data: words before the span more than most, check digits yet more.
#: 0: its yes says nothing, as a candidate is taken up by much the same form; its no does.
WEIGHT = np.array([[0, 3 if KINDS[k] in ("card", "account") else 0, 1, 2, 1] for k in range(len(KINDS))])
#: Weight of that trust, as a share of a kind's candidates.
PRIOR = 0.02


def estimate(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """P(personal) for each pattern, by EM over the labelers' reliabilities for each kind."""
    pats = sorted(counts)
    n = np.array([counts[p] for p in pats], dtype=float)
    parts = [unpack(p) for p in pats]
    kind = np.array([x[0] for x in parts])
    vote = np.array([x[1] for x in parts]) + 1
    q = np.clip(0.5 + 0.1 * ((vote - 1) * np.maximum(1, WEIGHT[kind])).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        new = np.zeros(len(pats))
        for k in np.unique(kind):
            of = kind == k
            w1, w0 = (n * q)[of], (n * (1 - q))[of]
            odds = np.full(of.sum(), math.log((w1.sum() + 1) / (w0.sum() + 1)))
            for j in range(LABELERS):
                # reliabilities, drawn towards labelers that are right more often than not, at any size of the corpus
                t, share = WEIGHT[k, j], 1 + PRIOR * n[of].sum()
                yes, no = ((1, 2 * t, 4 * t * t), (4 * t * t, 2 * t, 1)) if t else ((1, 2, 4), (2, 2, 2))
                one, zero = np.bincount(vote[of, j], w1, 3) + np.multiply(yes, share), np.bincount(vote[of, j], w0, 3) + np.multiply(no, share)
                odds += (np.log(one / one.sum()) - np.log(zero / zero.sum()))[vote[of, j]]
            new[of] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        q = new
    return dict(zip(pats, q.tolist(), strict=True))


def train(found: list[list[int]], soft: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on features towards the estimated probabilities, by accelerated gradient."""
    w = np.zeros(FEATURES)
    if not len(found):
        return w
    rows, cols = np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([np.asarray(x, dtype=np.int64) for x in found])
    n = len(found)
    step, z, t = 4.0 / max(len(x) for x in found), w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=z[cols], minlength=n), -30, 30)))
        new = z - step * (np.bincount(cols, weights=(p - soft)[rows], minlength=FEATURES) / n + l2 * z)
        ahead = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    return w


@dataclass
class Model:
    weights: np.ndarray
    threshold: float = ACCEPT

    def takes(self, feats: list[int]) -> bool:
        z = float(self.weights[feats].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) >= self.threshold


SPAN = "struct<start:int,kind:int,`end`:int,base:boolean,pattern:int,features:array<int>>"
ROWS = f"doc_id long, spans array<{SPAN}>"
SPAN_TYPE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))])


def candidates(text: str | None) -> list[dict]:
    """All candidate spans of a text with votes and features."""
    text = text or ""
    base = base_spans(text)
    out = []
    for is_base, found in ((True, base), (False, loose_spans(text, base))):
        for kind, a, b in found:
            span, (before, after) = text[a:b], around(text, a, b)
            out.append({"start": a, "kind": kind, "end": b, "base": is_base, "pattern": pattern(kind, votes(kind, span, before, after, is_base), is_base), "features": features(kind, span, before, after)})
    return out


def candidate_rows(batches):
    for batch in batches:
        found = [candidates(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(SPAN_TYPE))], names=["doc_id", "spans"])


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.sort_array(order), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_in(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(candidate_rows, ROWS))


def fitted(found: DataFrame, threshold: float = ACCEPT, max_fit: int = MAX_FIT) -> Model:
    """The classifier for the candidates of a corpus."""
    each = found.select("doc_id", F.explode("spans").alias("s"))
    counts = {r["p"]: r["n"] for r in each.groupBy(F.col("s.pattern").alias("p")).agg(F.count("*").alias("n")).collect()}
    soft = estimate(counts) if counts else {}
    # a share by hash that holds somewhat more than max_fit goes to the driver, whatever the number of tasks
    share = min(1.0, (1.1 * max_fit + 1000) / max(1, sum(counts.values())))
    own = each.select(F.col("s.pattern").alias("p"), F.col("s.features").alias("f"), F.xxhash64("doc_id", "s.start", "s.kind").alias("h"), "doc_id", F.col("s.start").alias("at"))
    sample = own.filter(F.shiftrightunsigned("h", 32) < int(share * (1 << 32))).orderBy("h", "doc_id", "at", "p").limit(max_fit).collect()
    return Model(train([r["f"] for r in sample], np.array([soft[r["p"]] for r in sample])), threshold)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = ACCEPT) -> DataFrame:
    """One row for each document: doc_id, spans (start, kind, end, base, pattern, features), those of the base and those added."""
    found = found_in(docs, id_col, text)
    model = fitted(found, threshold)

    def decided(batches):
        for batch in batches:
            kept = [[s for s in spans if s["base"] or model.takes(s["features"])] if spans else [] for spans in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(SPAN_TYPE))], names=["doc_id", "spans"])

    return found.mapInArrow(decided, ROWS)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base spans for each kind, base_sha256, spans, n_added (spans that the method adds), personal (any span)."""
    found = find_pii(docs, id_col, text)
    base = F.filter("spans", lambda s: s["base"])
    # a function of two parameters would get the place of the span as its second, whatever its default
    is_base = lambda kind: lambda s: s["base"] & (s["kind"] == kind)
    counts = [F.size(F.filter("spans", is_base(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), added, (F.size("spans") > 0).alias("personal"))


def masked(text: str, spans: list[dict]) -> str:
    """text with each stretch of overlapping spans as [KIND], the kind of the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = ACCEPT) -> DataFrame:
    """docs with personal data masked in the text, row by row; the classifier is fitted to these documents first."""
    model = fitted(found_in(docs, id_col, text), threshold)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = [t and masked(t, [s for s in candidates(t) if s["base"] or model.takes(s["features"])]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
