"""Personal data by weak supervision (built-in functions only).

Candidate spans come from linear-time patterns. Four labelers vote on each: the shape of the text, a
validity check, gazetteers and the words before it. A span's votes, kind and length class form one
of a fixed number of patterns, so the corpus reduces to a small table of pattern counts.
Expectation-maximisation over that table estimates how reliable each labeler is for each kind; the
expected labels then train a logistic span classifier over the same patterns. Base spans always
stay; other candidates are added where the classifier is sure enough.

Beyond the base patterns and secrets, four wider forms propose candidates of the base kinds: addresses
written out ("name (at) host (dot) org"), IPv6 addresses, cards with other separators, and phone
numbers without "+". Nothing of these is a base span, so the labelers and the classifier alone decide.

``train_and_find`` reads the texts once and stores the candidates between counting and labelling;
``train`` and ``redact`` read them twice, each time in one narrow stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import documents, materialize, table

KINDS = ["email", "ip", "card", "phone", "secret"]
#: Forms that candidates come in, with the kind each reports; the first five are the kinds' own patterns.
FORMS = {
    "email": "email", "ip": "ip", "card": "card", "phone": "phone", "secret": "secret",
    "email_written": "email", "ip_v6": "ip", "card_separated": "card", "phone_national": "phone",
}
#: Digits in groups are common in clean text, so these are added only behind a word that speaks for them.
NEEDS_CONTEXT = ("card_separated", "phone_national")
#: Spans that are no base matches are added from this probability.
THRESHOLD = 0.7
LABELERS = ["shape", "validity", "gazetteer", "context"]
ABSTAIN, YES, NO = 0, 1, 2
LENGTH_CLASSES = 4
N_PATTERNS = len(FORMS) * 3 ** len(LABELERS) * LENGTH_CLASSES

#: Each starts only where a run starts (or the last match ended) and never gives back, so a search is linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{20,}+",
    "email_written": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*+(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]++)++",
    "ip_v6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)[0-9A-Fa-f:]++(?![0-9A-Za-z])",
    "card_separated": r"(?<![0-9][\x20._/-]{0,3})[0-9](?:[\x20._/-]{0,3}+[0-9]){11,}+",
    "phone_national": r"(?<![0-9A-Za-z+().,_/-])(?<![0-9)][\x20])\(?[0-9](?:\)?[\x20./-]?\(?[0-9]){6,}+",
}
#: A text without this has no match, so its pattern is not searched.
NEEDED_TEXT = {"email": "@", "phone": "+", "ip_v6": ":"}
TOP_DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|be|us|ca|au|jp|cn|in|br|ru"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
PRIVATE_NETWORKS = r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2[0-9]|3[01])|2[3-5][0-9])\."
KEY_PREFIXES = "^(sk-|pk_|ghp_|gho_|xox[abp]-|AKIA|AIza|eyJ)"
WORDS_FOR = {
    "email": "mail|contact|write|reach|correo|schreib",
    "ip": r"\bip\b|address|host|server|client|addr",
    "card": "card|visa|master|amex|payment|tarjeta|carte|karte",
    "phone": r"phone|tel\b|tel\.|call|fax|mobile|telefon|llam",
    "secret": "token|secret|key|passw|pwd|bearer|auth|credential",
}
WORDS_AGAINST = {
    "email": r"example\s*:",
    "ip": r"version|\bv\.?\s*$|section|chapter|release",
    "card": r"isbn|order|invoice|serial|tracking|\bid\b",
    "phone": r"isbn|order|version|part",
    "secret": r"sha\d*|md5|commit|checksum|hash|uuid|https?:|/\S*$",
}


def _votes(kind: str, m: Column, before: Column) -> list[Column]:
    """Votes of the four labelers on the text ``m``, of a form ``kind``, with ``before`` in front of it."""

    def vote(yes: Column, no: Column | None = None) -> Column:
        no = ~yes if no is None else no
        return F.when(yes, F.lit(YES)).when(no, F.lit(NO)).otherwise(F.lit(ABSTAIN))

    digits = F.regexp_replace(m, "[^0-9]", "")
    never = F.lit(False)
    if kind == "email_written":
        shape = vote(m.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]"), ~m.rlike(r"(?i)[\[({\x20]dot[\])}\x20]"))
        valid = vote(F.length(m) <= 254)
        listed = vote(F.lower(m).rlike(rf"[^a-z0-9-]({TOP_DOMAINS})$"))
    elif kind == "ip_v6":
        shape = vote(_groups(m) >= 3, _groups(m) < 2)
        valid = vote(_is_v6(m))
        listed = vote(m.rlike("^[23][0-9A-Fa-f]{3}:"), m.rlike("(?i)^(fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}|):"))
    elif kind == "card_separated":
        shape = vote(m.rlike(r"^[0-9]{4}([ ._/-]{1,3})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ ._/-]{1,3})[0-9]{6}\2[0-9]{5}$"))
        valid = vote(_luhn(m) & ~m.rlike("^[0-9]([ -]?[0-9])+$"))
        listed = vote(digits.rlike("^[3-6]"))
    elif kind == "phone_national":
        shape = vote(m.rlike(r"^(\([0-9]{2,5}\)|[0-9]{2,5})([ ./-]?[0-9]{2,8}){1,5}$") & m.rlike("[^0-9]"))
        valid = vote(F.length(digits).between(7, 15) & ~_luhn(m) & ~(m.rlike(r"^[0-9]+(\.[0-9]+){3}$") & _octets_fit(m)))
        listed = vote(digits.rlike("^0[1-9]|^00[1-9]"), m.rlike(r"^(19|20)[0-9]{2}[./-][01]?[0-9][./-]|^[0-3]?[0-9][./-][01]?[0-9][./-](19|20)[0-9]{2}"))
    elif kind == "email":
        shape = vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"))
        valid = vote(~m.contains("..") & (F.length(m) <= 254))
        listed = vote(F.lower(m).rlike(rf"\.({TOP_DOMAINS})$"), never)
    elif kind == "ip":
        shape = vote(m.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"))
        valid = vote(_octets_fit(m))
        listed = vote(never, m.rlike(PRIVATE_NETWORKS))
    elif kind == "card":
        shape = vote(m.rlike(r"^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$"))
        valid = vote(_luhn(m))
        listed = vote(digits.rlike("^[3-6]"))
    elif kind == "phone":
        shape = vote(m.rlike(r"^\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)|[0-9]{1,4})([ .-]?[0-9]{2,5}){1,4}$"))
        valid = vote(F.length(digits).between(9, 15))
        listed = vote(digits.rlike(f"^({COUNTRY_CODES})"))
    else:
        shape = vote(m.rlike("^([0-9a-f]{32,}|[0-9A-F]{32,}|[0-9A-Za-z_-]{24,})$"))
        valid = vote(F.length(digits) * 6 >= F.length(m), F.length(digits) * 20 < F.length(m))
        listed = vote(m.rlike(KEY_PREFIXES), never)
    named = before.rlike(rf"(?i)({WORDS_FOR[FORMS[kind]]})\W*$")
    if kind in NEEDS_CONTEXT:
        return [shape, valid, listed, vote(named)]
    return [shape, valid, listed, vote(named, before.rlike(rf"(?i)({WORDS_AGAINST[FORMS[kind]]})\W*$"))]


def _groups(m: Column) -> Column:
    return F.size(F.array_remove(F.split(m, ":", -1), ""))


def _is_v6(m: Column) -> Column:
    """Eight groups of at most four hexadecimal digits, or fewer with one double colon."""
    short = m.contains("::")
    fits = (~short & (_groups(m) == 8)) | (short & (F.size(F.split(m, "::", -1)) == 2) & _groups(m).between(1, 7))
    return fits & ~m.rlike("[0-9A-Fa-f]{5}|:::|^:[^:]|[^:]:$")


def _octets_fit(m: Column) -> Column:
    """Every part is at most 255, leading zeros or not."""
    bare = lambda x: F.ltrim(x, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda x: (F.length(bare(x)) <= 3) & (F.coalesce(bare(x).try_cast("int"), F.lit(0)) <= 255))


def _luhn(m: Column) -> Column:
    """12 to 19 digits that pass the Luhn check."""
    reverse = F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), "")
    sums = F.transform(
        reverse,
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") * 2 > 9, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)),
    )
    return F.size(reverse).between(12, 19) & (F.aggregate(sums, F.lit(0), lambda a, x: a + x) % 10 == 0)


def _is_base(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets_fit(m)
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(kind == "email")


def _length_class(m: Column) -> Column:
    n = F.length(m)
    return F.when(n < 12, 0).when(n < 20, 1).when(n < 40, 2).otherwise(3)


def _found(kind: str, text: Column) -> Column:
    """Spans of a form: array of struct(start, kind, end, base, pattern), in code points, end exclusive."""
    number, pattern, reported = list(FORMS).index(kind), F.lit(PATTERNS[kind]), KINDS.index(FORMS[kind])
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,pattern:int>>")
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind in NEEDED_TEXT:
        matches = F.when(text.contains(NEEDED_TEXT[kind]), matches).otherwise(F.array().cast("array<string>"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["m"])
        code = F.lit(number)
        for v in _votes(kind, pair["m"], F.right(pair["gap"], F.lit(40))):
            code = code * 3 + v
        span = F.struct(
            start.cast("int").alias("start"), F.lit(reported).alias("kind"), end.cast("int").alias("end"),
            _is_base(kind, pair["m"]).alias("base"), (code * LENGTH_CLASSES + _length_class(pair["m"])).cast("int").alias("pattern"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)
    return F.when(F.size(matches) > 0, walked["spans"]).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start, then kind as listed; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_found(k, text) for k in FORMS]))


def _factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form, votes and length class of each pattern number."""
    rest = np.arange(N_PATTERNS)
    rest, length = rest // LENGTH_CLASSES, rest % LENGTH_CLASSES
    votes = []
    for _ in LABELERS:
        votes.insert(0, rest % 3)
        rest = rest // 3
    return rest, np.array(votes).T, length


def expectation_maximisation(counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expected label of each pattern and P(vote | form, labeler, label), from pattern counts alone.

    Starts from the majority of votes; Dirichlet smoothing keeps every probability above 0, and the
    pseudo-counts favour labelers that agree with the label, so labels can't swap.
    """
    kind, votes, _ = _factors()
    yes, no = (votes == YES).sum(1), (votes == NO).sum(1)
    label = (1 + yes) / (2 + yes + no)
    lean = np.array([[2.0, 1.0, 3.0], [2.0, 3.0, 1.0]])  # pseudo-counts by label and vote
    reliability = np.zeros((len(FORMS), len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = np.array([(1 + (counts * label)[kind == k].sum()) / (2 + counts[kind == k].sum()) for k in range(len(FORMS))])
        for k in range(len(FORMS)):
            for j in range(len(LABELERS)):
                for v in range(3):
                    at = (kind == k) & (votes[:, j] == v)
                    reliability[k, j, 1, v] = lean[1, v] + (counts * label)[at].sum()
                    reliability[k, j, 0, v] = lean[0, v] + (counts * (1 - label))[at].sum()
        reliability /= reliability.sum(3, keepdims=True)
        log = np.log(np.stack([1 - prior, prior], 1))[kind]
        for j in range(len(LABELERS)):
            log = log + np.log(reliability[kind, j, :, votes[:, j]])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        moved, label = np.abs(new - label)[counts > 0].max(initial=0), new
        if moved < 1e-9:
            break
    return label, reliability


def fit_span_classifier(counts: np.ndarray, label: np.ndarray, rounds: int = 60, penalty: float = 0.3) -> np.ndarray:
    """Probability of each pattern by a logistic model over form, form x vote and length class, fitted on expected labels."""
    kind, votes, length = _factors()
    columns = [np.eye(len(FORMS))[kind], np.eye(LENGTH_CLASSES)[length]]
    for j in range(len(LABELERS)):
        cell = np.zeros((N_PATTERNS, len(FORMS) * 2))
        cell[np.arange(N_PATTERNS), kind * 2 + np.maximum(votes[:, j] - 1, 0)] = votes[:, j] > 0
        columns.append(cell)
    x, seen = np.hstack(columns), counts > 0
    w = np.zeros(x.shape[1])
    weight = np.sqrt(counts[seen])  # frequent patterns must not drown rare ones
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x[seen] @ w, -30, 30)))
        hessian = (x[seen] * (weight * p * (1 - p))[:, None]).T @ x[seen] + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x[seen].T @ (weight * (label[seen] - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def train(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The classifier: a probability for each pattern number. At most N_PATTERNS counts come to the driver.

    Null and empty texts have no candidates; an empty table leaves the classifier at its prior.
    """
    return _fit(docs.select(candidates(F.col(f"`{text_col}`")).alias("found")))


def _fit(stored: DataFrame) -> list[float]:
    """The classifier from the candidates in ``found``."""
    found = stored.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    counts = np.zeros(N_PATTERNS)
    for r in found.collect():
        counts[r.pattern] = r.n
    label, _ = expectation_maximisation(counts)
    return fit_span_classifier(counts, label).tolist()


def spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Base spans and added spans of a text, by start, then kind.

    A span that fails its validity check is never added, nor one of the forms in NEEDS_CONTEXT without its word.
    """
    return _chosen(candidates(text), model, threshold)


def _chosen(found: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    form, votes, _ = _factors()
    fits = votes[:, LABELERS.index("validity")] != NO
    fits &= ~np.isin(form, [list(FORMS).index(f) for f in NEEDS_CONTEXT]) | (votes[:, LABELERS.index("context")] == YES)
    chosen = F.array(*[F.lit(bool(p >= threshold and v)) for p, v in zip(model, fits)])
    return F.filter(found, lambda s: s["base"] | F.get(chosen, s["pattern"]))


def find(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (array of start, kind, end, base, pattern).

    Null texts have no spans; null and repeated ids keep their rows; an empty table gives no rows.
    """
    return documents(docs, id_col, text_col).select("doc_id", spans(F.col("text"), model, threshold).alias("spans"))


def train_and_find(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``find`` gives with the classifier trained on the same documents.

    The texts are read once: their candidates, a few numbers each, are stored between counting and labelling.
    """
    stored = materialize(documents(docs, id_col, text_col).select("doc_id", candidates(F.col("text")).alias("found")))
    return stored.select("doc_id", _chosen(F.col("found"), _fit(stored), threshold).alias("spans"))


def redact(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""

    def join(merged: Column, s: Column) -> Column:
        last = F.get(merged, F.size(merged) - 1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(merged) > 0) & (s["start"] < last["end"]), F.concat(F.slice(merged, 1, F.greatest(F.size(merged) - 1, F.lit(0))), F.array(longer))).otherwise(
            F.concat(merged, F.array(one))
        )

    text = F.col(f"`{text_col}`")
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    names = F.array(*map(F.lit, KINDS))
    marked = docs.withColumn("__spans", F.aggregate(spans(text, model, threshold), empty, join))
    at = F.col("__spans")
    pieces = F.transform(
        at,
        lambda s, i: F.concat(
            F.substring(text, F.coalesce(F.get(at, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(at, i - 1)["end"], F.lit(0))),
            F.lit("["), F.get(names, s["kind"]), F.lit("]"),
        ),
    )
    tail = F.substring(text, F.get(at, F.size(at) - 1)["end"] + 1, F.length(text))
    return marked.withColumn(text_col, F.when(F.size(at) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)).drop("__spans")


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = train_and_find(docs).withColumn("base", F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
