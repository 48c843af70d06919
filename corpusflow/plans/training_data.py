"""Tokenizer training, example construction and evaluation jobs.

Each composes operators only; the tokenizer itself is trained and applied by
Spark jobs (``operators.bpe``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.bpe import BpeModel, encode, train_bpe
from corpusflow.operators.examples import (MASK_PROB, MAX_LENGTH, denoising_examples,
                                           require_specials, translation_examples)
from corpusflow.operators.metrics import corpus_bleu
from corpusflow.operators.pairs import DEFAULT_PREFIX, resolve_pairs, union_corpora, with_prefix
from corpusflow.operators.sample import choose_eval, head_n
from corpusflow.session import materialize


def train_tokenizer(corpora: Sequence[tuple[str, DataFrame]], vocab_size: int = 32000,
                    mode: str = "exact", **kw) -> BpeModel:
    """One vocabulary over the concatenation of the corpora (B6 -> T2-T5)."""
    return train_bpe(union_corpora(corpora), "text", vocab_size=vocab_size, mode=mode, **kw)


def build_denoising_examples(corpora: Sequence[tuple[str, DataFrame]], model: BpeModel,
                             max_length: int = MAX_LENGTH, mask_prob: float = MASK_PROB,
                             seed: int = 42, epoch: int = 0, mask_eos: bool = False) -> DataFrame:
    """C4: union -> encode -> truncate, mask, EOS, pad. Keys ``corpus_no, row_id``."""
    sp = require_specials(model, ("[PAD]", "[SEP]", "[MASK]"))
    u = union_corpora(corpora)
    enc = encode(u, "text", model, ["corpus_no", "row_id"])
    # the noise key is both fields, so it is unique whatever the row ids are
    keyed = enc.withColumn("_rid", F.concat_ws(":", "corpus_no", "row_id"))
    ex = denoising_examples(keyed, "ids", "_rid", eos_id=sp["[SEP]"], pad_id=sp["[PAD]"],
                            mask_id=sp["[MASK]"], max_length=max_length, p=mask_prob, seed=seed,
                            epoch=epoch, mask_eos=mask_eos)
    return ex.drop("_rid")


def build_translation_examples(pairs: DataFrame, model: BpeModel, src_lang: str = "en",
                               tgt_lang: str = "bn", prefix: str | None = DEFAULT_PREFIX,
                               max_input_length: int = MAX_LENGTH,
                               max_target_length: int = MAX_LENGTH,
                               eval_pairs: DataFrame | None = None, val_size: float = 0.01,
                               seed: int = 42, max_train: int | None = None,
                               max_eval: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, validation) example tables from a parallel corpus with
    ``row_id``: K3/K2 split -> K1 caps -> B7 prefix -> T8 both sides -> E6."""
    sp = require_specials(model)
    if eval_pairs is None:  # the split reads its input several times
        pairs = materialize(pairs, "translation-pairs")
    train, val = choose_eval(pairs, eval_pairs, val_size, seed)

    def build(df: DataFrame, cap: int | None) -> DataFrame:
        df = head_n(df, cap)
        r = resolve_pairs(df, src_lang, tgt_lang).select("row_id", "_src", "_tgt")
        r = r.withColumn("_src", with_prefix("_src", prefix))
        # both sides in one narrow pass: no join, no shuffle
        r = encode(r, "_src", model, ["row_id", "_tgt"], "src_ids")
        r = encode(r, "_tgt", model, ["row_id", "src_ids"], "tgt_ids")
        return translation_examples(r, "src_ids", "tgt_ids",
                                    eos_id=sp["[SEP]"], pad_id=sp["[PAD]"],
                                    max_input_length=max_input_length,
                                    max_target_length=max_target_length)

    return build(train, max_train), build(val, max_eval)


def evaluate_pairs(scored: DataFrame, pred_col: str = "pred", ref_col: str = "ref",
                   key_cols: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """BLEU over (prediction, reference) rows; ``max_rows`` keeps the first
    rows in order (the evaluation cap): None = all, 0 = none, so no score."""
    key_cols = key_cols or ["row_id"]
    scored = head_n(scored, max_rows, key_cols)
    return corpus_bleu(scored, pred_col, ref_col, key_cols)
