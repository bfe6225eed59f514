"""Fixed values that results depend on.

FIXED VALUES: these must stay exactly as written for results to agree with
the documented behaviour (label order, entity types, venue list, patterns).
"""

# --- fixed values: tag vocabulary, id = list position -----------------------
LABELS = [
    "O",
    "B-MethodName", "I-MethodName",
    "B-HyperparameterName", "I-HyperparameterName",
    "B-HyperparameterValue", "I-HyperparameterValue",
    "B-MetricName", "I-MetricName",
    "B-MetricValue", "I-MetricValue",
    "B-TaskName", "I-TaskName",
    "B-DatasetName", "I-DatasetName",
]

# --- fixed values: entity types in label order ------------------------------
ENTITY_TYPES = [
    "MethodName", "HyperparameterName", "HyperparameterValue",
    "MetricName", "MetricValue", "TaskName", "DatasetName",
]

# --- fixed values: target venues of the bibliography filter -----------------
TARGET_VENUES = [
    "Proceedings of the 60th Annual Meeting of the Association for Computational Linguistics (Volume 1: Long Papers)",
    "Proceedings of the 60th Annual Meeting of the Association for Computational Linguistics (Volume 2: Short Papers)",
    "Proceedings of the 59th Annual Meeting of the Association for Computational Linguistics and the 11th International Joint Conference on Natural Language Processing (Volume 1: Long Papers)",
    "Proceedings of the 59th Annual Meeting of the Association for Computational Linguistics and the 11th International Joint Conference on Natural Language Processing (Volume 2: Short Papers)",
    "Proceedings of the 58th Annual Meeting of the Association for Computational Linguistics",
    "Proceedings of the 2022 Conference of the North American Chapter of the Association for Computational Linguistics: Human Language Technologies",
    "Proceedings of the 2021 Conference of the North American Chapter of the Association for Computational Linguistics: Human Language Technologies",
    "Proceedings of the 2019 Conference of the North American Chapter of the Association for Computational Linguistics: Human Language Technologies, Volume 1 (Long and Short Papers)",
    "Proceedings of the 2021 Conference on Empirical Methods in Natural Language Processing",
    "Proceedings of the 2020 Conference on Empirical Methods in Natural Language Processing (EMNLP)",
    "Proceedings of the 2019 Conference on Empirical Methods in Natural Language Processing and the 9th International Joint Conference on Natural Language Processing (EMNLP-IJCNLP)",
]

# --- fixed values: annotation patterns (Java regex syntax) ------------------
# Number pattern.  The search restarts after every match, so the digit
# lookbehind may not see text consumed by the previous match; \G (end of the
# previous match) restores that behaviour inside one Java scan.  The leading
# (?=\d) only makes non-digit positions fail before the lookbehinds run.
METRIC_VALUE_PATTERN = (
    r"(?i)(?=\d)(?<!table\s|fig\s|figure\s|section\s)"
    r"(?:(?<=\G)|(?<=\G.)|(?<!\d.))"
    r"\d[.]?[^a-z\s][\d]*[%]?"
)
HYPERPARAMETER_VALUE_PATTERN = r"(?i)\d+[e][-]?[\d]*"
YEAR_LIKE_PATTERN = r"(19|20)\d{2}"

METRIC_LABEL = "MetricValue"
HYPERPARAMETER_LABEL = "HyperparameterValue"

# --- fixed values: annotation record constants ------------------------------
ANNOTATION_FROM_NAME = "label"
ANNOTATION_TO_NAME = "text"
ANNOTATION_TYPE = "labels"

# --- fixed values: sentinels -------------------------------------------------
IGNORE_INDEX_BASELINE = -1
IGNORE_INDEX_ALIGNED = -100
ABBREVIATION_SUFFIXES = ["et al .", "e.g.", "i.e."]
