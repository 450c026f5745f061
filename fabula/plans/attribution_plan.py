"""The whole attribution of manuscripts: dimensions, rules in their order, post-passes, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lines import parse_lines, render
from ..operators import attribution as A
from ..operators import folds, legend, metrics, normalize, scenes, split_merge, thoughts
from .registry import Registry, checkpointed

RULES = Registry(cuts={"reset_dialogs", "thoughts_near_aphorism", "possessive_voice", "pronouns_and_vocatives", "pair_lock", "flips_gaps_consensus", "clean_punctuation"})

# phases and priorities: fixed values, as results depend on the order
RULES.rule(25, 10, "narrator_dialogs")(thoughts.narrator_dialogs)
RULES.rule(40, 0, "lookalikes")(lambda x: x.withColumn("body", normalize.fix_lookalikes(x["body"])))
RULES.rule(41, 0, "dialog_punctuation")(normalize.normalize_dialog_punct)
RULES.rule(42, 0, "blocks")(scenes.with_block)
RULES.rule(45, 0, "split_mixed")(split_merge.split_mixed)
RULES.rule(53, 0, "scene_constraints")(lambda x: A.demote_forbidden(scenes.with_scene(x)))
RULES.rule(60, 1, "reset_dialogs")(normalize.reset_dialogs)
RULES.rule(72, 9, "inline_sayer")(A.inline_sayer)
RULES.rule(72, 10, "inline_no_verb")(A.inline_no_verb)
RULES.rule(72, 11, "inline_verb_name")(A.inline_verb_name)
RULES.rule(72, 12, "demote_thoughts")(thoughts.demote_thoughts)
RULES.rule(72, 12, "inline_first_person")(A.inline_first_person)
RULES.rule(72, 13, "thoughts")(thoughts.thoughts_to_tag)
RULES.rule(72, 13, "thoughts_near_aphorism")(thoughts.demote_near_aphorism)
RULES.rule(73, 5, "rank_title_leadin")(thoughts.rank_title_leadin)
RULES.rule(73, 6, "first_person_leadin")(thoughts.first_person_leadin)
RULES.rule(73, 8, "heard_voice")(A.heard_voice)
RULES.rule(73, 8, "leadin_sayer")(A.leadin_sayer)
RULES.rule(73, 8, "named_leadin")(A.named_leadin)
RULES.rule(73, 9, "possessive_voice")(A.possessive_voice)
RULES.rule(73, 12, "pronouns_and_vocatives")(lambda x: folds.fold(x, folds.BEFORE_PAIR))
RULES.rule(74, 1, "mark_blocks")(thoughts.mark_blocks)
RULES.rule(74, 2, "block_child_after_prologue")(thoughts.block_child_after_prologue)
RULES.rule(74, 5, "first_person_to_child")(thoughts.first_person_to_child)
RULES.rule(74, 6, "pair_lock")(lambda x: folds.fold(x, folds.PAIR))
RULES.rule(74, 99, "keep_inline_name")(A.inline_verb_name)
RULES.rule(75, 99, "demote_forbidden")(lambda x: A.demote_forbidden(A.with_prologue(scenes.with_scene(x)), strict=True))
RULES.rule(77, 0, "flips_gaps_consensus")(lambda x: folds.fold(scenes.with_scene(x), folds.AFTER_PAIR))
RULES.rule(80, 0, "extract_attribution")(split_merge.extract_attribution)
RULES.rule(81, 0, "merge_split")(lambda x: split_merge.merge_around_attribution(x, "«", tidy=False))
RULES.rule(82, 0, "clean_punctuation")(normalize.clean_dialog_punctuation)
RULES.rule(84, 0, "merge_lines")(split_merge.merge_around_attribution)
RULES.rule(86, 0, "merge_all")(split_merge.merge_dialogs)
RULES.rule(98, 0, "block_markers")(normalize.remove_block_markers)

_LINES = ("doc_id", "line_no", "raw", "indent", "gid", "body")


def casts_of(legends: DataFrame) -> DataFrame:
    """(doc_id, cast) of legends (doc_id, text); documents whose legends are the same text share one, made once."""
    texts = legends.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("text"))), 256).alias("_text"))
    kinds = texts.groupBy("_text").agg(F.min("doc_id").alias("_like"))
    made = legend.cast(legend.parse_legend(legends.join(kinds, F.col("doc_id") == F.col("_like"), "left_semi")))
    like = texts.join(kinds, "_text").select("doc_id", "_like")
    return like.join(made.withColumnRenamed("doc_id", "_like"), "_like").select("doc_id", "cast")


def _attributed(docs: DataFrame, legends: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    casts = checkpointed(casts_of(legends))  # each fold attaches it anew
    lines = RULES.run(parse_lines(docs), casts, skip)
    return normalize.collapse_same_tags(normalize.demote_narrator_dialogs(normalize.narrator_fallback(lines)))


def attribute(docs: DataFrame, legends: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """The tagged lines of ``docs`` (doc_id, text), given ``legends`` (doc_id, text); without the rules named in ``skip``."""
    return _attributed(docs, legends, skip).select(*_LINES)


def failures(docs: DataFrame, legends: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, rule, error): the rules that raised on a document, which they left as it was."""
    return folds.failures(_attributed(docs, legends, skip))


def process(docs: DataFrame, legends: DataFrame) -> DataFrame:
    """(doc_id, text): the tagged manuscripts."""
    return render(attribute(docs, legends))


def report(docs: DataFrame, legends: DataFrame) -> DataFrame:
    """Coverage by document and scene."""
    return metrics.coverage(scenes.with_scene(attribute(docs, legends)))


def classified(docs: DataFrame, legends: DataFrame) -> DataFrame:
    """The lines of ``docs`` pre-tagged, and unknown speech given to characters by similarity; punctuation in ASCII throughout."""
    from ..operators import speaker_model

    named = legend.parse_legend(legends)
    plain = parse_lines(docs).withColumn("body", normalize.normalize_punctuation_ascii(F.col("body")))
    lines = normalize.pretag(plain).where("gid is not null")
    found = speaker_model.classify(lines, legend.characters(named), legend.name_forms(named))
    return speaker_model.apply_decisions(lines, found)
