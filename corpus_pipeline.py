"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and all rows that the one before it kept, and all but the
last return the columns of documents. The last returns packed pieces (see quillspark.llm.packing).

Defined cases, in all stages: an empty table gives an empty one; nulls in lang, source and n_chars pass through; columns
beyond those of documents are kept by all stages but the last, whatever their names. A null text fails the quality rules' base
rule and goes; given to the other stages it has no words (near-duplicates: fingerprint zero, like all empty texts, of which one
stays), no windows, no secrets, and packs as its closing id. Repeated rows are judged alike by the quality rules,
decontamination and the secret scan; of repeated rows near-duplicates keep one; packing places each."""

from functools import wraps

from quillspark.llm import decontam, packing, quality, secrets, simhash
from quillspark.llm.common import TABLES, materialize, release, release_unread, table

_made: list[str] = []  # paths of the tables that the last stage made along the way


def stage(f):
    """A stage's result must be written before the next one is called: that deletes the tables which the
    stage before it made along the way, but for those that docs still reads."""

    @wraps(f)
    def run(spark, docs, sf_dir):
        kept = release_unread(docs, _made)
        known = set(TABLES)
        out = f(spark, docs, sf_dir)
        _made[:] = kept + [t for t in TABLES if t not in known]
        return out

    return run


@stage
def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule or a learned rule rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark, docs, sf_dir):
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


@stage
def decontamination(spark, docs, sf_dir):
    """Documents with a whole window of eight words of a benchmark item, or with windows of two items, go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def secret_scan(spark, docs, sf_dir):
    """Secrets are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


@stage
def best_fit_packing(spark, docs, sf_dir):
    """What is left is packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, rules learned from labels and subword ids have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            if k:
                release(before)
    return docs
