"""The two workbooks of a study: a subject book and a visit book, read into canonical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import age_group_of_label, visit_of_label
from cohortlens.operators import harmonise as H
from cohortlens.sources.sheets import HeaderRules, harmonised
from cohortlens.vocab import BIRTH_PLACE_RECODE, VIRAL_LOAD_SHEET_PLACEHOLDERS

# --- fixed values: header spellings of the visit book -> one spelling each ----------------
VISIT_SYNONYMS = {
    "Study ID": "Study Number",
    "Visit 1": "Date of scan",
    "BMDL2-L4": "BMD L2-4 g/cm2",
    "Length of time on TDF (yrs)": "Duration on TDF (years)",
    "Duration of TDF (years)": "Duration on TDF (years)",
    "Length of time TAF (months)": "Duration on TAF (months)",
    "Duration of TAF (months)": "Duration on TAF (months)",
    "Reduced mobilisation inc hypertonic diplegia": "Reduced mobilisation",
    "Previous TDF exposure?": "Previous TDF",
    "Previous TAF exposure?": "Previous TAF",
    "Nadir CD4 (please review if changed from Visit 1)": "Nadir CD4",
}
VISIT_REWRITES = [(" other", "other"), (r"CDC \(yr\)", "CDC-C")]
DRUG_DETAIL = "ART detail"
DRUG_HEADERS = ["Current ART 1", "Current ART 2", "Current ART 3", "Current ART 4"]
# Header -> canonical column, in canonical order.
VISIT_COLUMNS = {
    "Study Number": "study_id", "Date of scan": "date_scan", "age_group": "age_group", "visit": "visit", "M/F": "sex",
    "Height": "height", "Weight": "weight", "BMD L2-4 g/cm2": "BMD", "LS Zscore age matched": "BMD_LS_Z",
    "Tscore LS": "tscore_LS", "Hip Zscore": "hip_Z", "Vitamin D": "vitD", "PTH": "PTH", "Calcium": "calcium",
    "Phosphate": "phosphate", "Alkaline phosphatase": "alkaline", "NTX": "NTX", "P1NP": "P1NP",
    "Previous TDF": "TDF_exp", "Duration on TDF (years)": "TDF_duration", "Previous TAF": "TAF_exp",
    "Duration on TAF (months)": "TAF_duration", "Current CD4": "CD4", "Nadir CD4": "CD4_nadir",
    "Current viral load (<20,<200,other)": "VL", "CDC-C diagnoses": "CDC_C", "Reduced mobilisation": "reduced_mobility",
    "Current ART 1": "ART1", "Current ART 2": "ART2", "Current ART 3": "ART3", "Current ART 4": "ART4",
}
NOT_ASKED_AT_FOLLOW_UP = ["TDF_exp", "TAF_exp", "CDC_C", "reduced_mobility"]
NUMBER_COLUMNS = ["height", "weight", "BMD", "BMD_LS_Z", "tscore_LS", "hip_Z", "calcium", "phosphate", "alkaline"]

# --- fixed values: header spellings of the subject book -----------------------------------
SUBJECT_REWRITES = [(r"CDC \(yr\)", "CDC C (yr)"), ("CDC  C", "CDC C")]
SUBJECT_COLUMNS = {
    "Subject ID": "age_gp", "Subject ID.1": "pt_id", "Ethnicity": "ethnicity", "Ethnicity.1": "ethnicity_other",
    "Height (cm)": "height", "Weight (kg)": "weight", "BMI": "BMI", "Current CD4": "CD4", "Nadir CD4": "CD4_nadir",
    "Current viral load (<20,<200,other)": "VL", "Current viral load (<20,<200,other).1": "VL_other",
    "CDC C (yr) diagnoses": "CDC_C", "CDC C (yr) diagnoses.1": "CDC_C_diag", "DEXA- VFA": "BMD_z",
    "Family Hx of bone disease": "fam_hx_bone_disease", "Family Hx of bone disease.1": "fam_hx_bone_disease_detail",
    "smoking (Y/N/ex)": "smoking", "alcohol units/wk": "alcohol_units", "Physical activity": "phys_activity",
    "Reduced mobilisation": "reduced_mobility", "Reduced mobilisation.1": "reduced_mobility_detail",
    "Born in the UK": "foreign_born", "Born in the UK.1": "foreign_born.1",
}
EMPTY_SUBJECT = "select last 3"
SUBJECT_DROPPED = ["foreign_born.1"]


VISIT_RULES = HeaderRules(
    columns=[c for c in VISIT_COLUMNS if c not in ("age_group", "visit")] + ["Detail"],
    required=[c for c in VISIT_COLUMNS if c not in ("age_group", "visit", "Previous TAF")],
    synonyms=VISIT_SYNONYMS, rewrites=VISIT_REWRITES, listed=(DRUG_DETAIL, DRUG_HEADERS),
)
SUBJECT_RULES = HeaderRules(columns=list(SUBJECT_COLUMNS), required=["Subject ID"], rewrites=SUBJECT_REWRITES)


def visit_book(book: DataFrame, sheets: Sequence[str]) -> DataFrame:
    """All visit sheets in canonical columns; plain number columns typed, the dirty ones left as text."""
    df = harmonised(book, sheets, VISIT_RULES).where(F.col("`M/F`").isNotNull())
    df = df.withColumns({"age_group": age_group_of_label(F.col("sheet")), "visit": visit_of_label(F.col("sheet"))})
    df = df.withColumnsRenamed(VISIT_COLUMNS)
    df = H.null_where(df, F.col("visit") == "follow-up", NOT_ASKED_AT_FOLLOW_UP)
    df = H.fill_placeholder(df, "VL", VIRAL_LOAD_SHEET_PLACEHOLDERS, "Detail")
    return df.select(*VISIT_COLUMNS.values()).withColumns({c: F.col(c).try_cast("double") for c in NUMBER_COLUMNS})


def subject_book(book: DataFrame, sheets: Sequence[str], prefix: str) -> DataFrame:
    """All subject sheets in canonical columns, placeholder rows out, with the composed study id in front."""
    df = harmonised(book, sheets, SUBJECT_RULES).where(F.col("`Subject ID`").isNotNull())
    df = df.select(*[F.col(f"`{c}`").alias(name) for c, name in SUBJECT_COLUMNS.items()]).drop(*SUBJECT_DROPPED)
    df = df.where(~F.col("pt_id").eqNullSafe(EMPTY_SUBJECT))
    df = H.recode(df, "foreign_born", {"select choice": BIRTH_PLACE_RECODE["select choice"]})
    return df.select(H.compose_id(prefix, "age_gp", "pt_id").alias("study_id"), *df.columns)
