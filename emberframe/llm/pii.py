"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import per_text, table, texts_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

#: Score before the context is looked at: a checksum says more than a shape.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
#: Characters before and after a span in which context words count, and what one is worth.
REACH, WORTH = 48, 0.2
FOR = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "client", "adresse"),
    "card": ("card", "credit", "visa", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "release", "order", "invoice", "example", "test", "sample", "isbn")
WORD = re.compile(r"\w+")

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


CONFIRM = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 if len(p) < 4 else int(p.lstrip("0")[:4] or 0) <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d),
    "phone": lambda s: 8 <= len(_digits(s)) <= 15,
    "iban": mod97,
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Confirmed spans of one text, by kind, then start. Each kind's matches do not overlap; a match that fails its
    check is dropped and not tried again from a later start."""
    found = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            if CONFIRM[kind](m[0]):
                near = WORD.findall(f"{text[max(0, m.start() - REACH) : m.start()]} {text[m.end() : m.end() + REACH]}".lower())
                score = PRIOR[kind] + WORTH * (any(w in FOR[kind] for w in near) - any(w in AGAINST for w in near))
                found.append((kind, m.start(), m.end(), round(min(1.0, max(0.0, score)), 3)))
    return found


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: for each row of ``docs`` its confirmed spans (kind, start, end, score) in code points, end
    exclusive, ordered by kind (email, ip, card, phone, iban), then start.

    No shuffle and no state: a row depends on its own text alone, so hot sources, copies and repeated rows need nothing
    special. A null or empty text has no spans, a null id stays null, an empty table gives no rows; other columns of
    ``docs`` are not looked at, whatever their names.
    """

    def rows(ids, texts):
        spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in texts]
        return {"doc_id": pa.array(ids, pa.int64()), "spans": pa.array(spans, SPANS)}

    return per_text(texts_of(docs, doc_id, text), rows, SCHEMA)


def op5_pii(spark, sf_dir):
    """Personal data in every document: counts of the base kinds, their digest, every span, and the scores in span order."""
    found = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    is_kind = lambda kind: lambda s: s["kind"] == kind
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: s["score"]).alias("scores"),
    )
