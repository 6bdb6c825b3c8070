"""The vocabularies whose text must be exactly this for results to be right.

They are data, not logic.  Every operator that uses one takes it as an argument or reads it from
the lookup tables built here, so another study passes its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: laboratory text --------------------------------------------------------
LAB_BELOW_LIMIT = "<10"
LAB_BELOW_LIMIT_VALUE = "9.5"
LAB_NOT_DONE = ("ND", "NR")
VIRAL_LOAD_PLACEHOLDER = "(pls specify if other)"
VIRAL_LOAD_WIDENED = ("<40",)
VIRAL_LOAD_BREAKS = [0.0, 20.0, 200.0, 1e8]
VIRAL_LOAD_CLASSES = ["<20", "<200", ">=200"]
VIRAL_LOAD_SHEET_PLACEHOLDERS = ("select choice", "Other - Please specify")

# --- fixed values: recodes ---------------------------------------------------------------
BIRTH_PLACE_RECODE = {
    "Entered the UK - Please specify entry date": "Born outside UK",
    "select choice": "Unknown",
}
BONE_TEXT_MARK = "osteo"

# --- fixed values: drug code -> class ----------------------------------------------------
DRUG_CLASSES = {
    "PI": ["DRV/r", "DRV/c", "LPV/r", "ATZ/c", "ATZ", "DRV"],
    "INSTI": ["DTG", "RAL", "EVG/c", "BIC", "CAB", "DOL"],
    "NRTI": ["ABC", "TDF", "TAF", "3TC", "FTC"],
    "NNRTI": ["RIL", "NVP", "EFV", "ETR"],
    "None": ["off art", "N/A", "None", "NR"],
}
OFF_TREATMENT_CODES = ("off art", "None")
NO_RESPONSE_CODE = "NR"
DRUG_COLUMNS = ["ART1", "ART2", "ART3", "ART4"]

# --- fixed values: bands and cut-offs ----------------------------------------------------
BMI_BREAKS = [0.0, 18.5, 25.0, 30.0, 50.0]
BMI_LABELS = ["<18.5", "[18.5-25)", "[25-30)", "30+"]
BMD_SLIP_LIMIT = 1000.0
VITAMIN_D_LOW = 50.0
PTH_HIGH = 7.2
CD4_NADIR_LOW = 200.0

# --- fixed values: ordered levels --------------------------------------------------------
LEVELS = {
    "visit": ["baseline", "follow-up"],
    "age_group": ["15-19", "20-24", "25+"],
    "abnormal_bmd": ["Normal", "Abnormal"],
    "VL": VIRAL_LOAD_CLASSES,
    "ART_reg": ["bPI_2NRTI", "INSTI_2NRTI", "NNRTI_2NRTI", "TDF", "TAF", "None", "Unknown"],
    "bmi_cat": BMI_LABELS,
    "smoke": ["No_ex", "Yes"],
    "ever_smoke": ["No", "Yes"],
    "alcohol": ["No", "Yes"],
    "TDF_exp": ["N", "Y"],
    "CDC_C": ["No", "Yes"],
    "fam_hx_bone_disease": ["No", "Yes"],
    "reduced_mobility": ["No", "Yes"],
    "cdcc_lowvl": ["0", "1"],
    "abnormal_vitD": ["0", "1"],
    "high_PTH": ["0", "1"],
    "PA": ["A", "B", "C", "D", "E"],
    "TAF_TDF": ["TDF", "TAF", "Non_TAF_TDF"],
    "TAF_fu_fct": ["Non-TAF/TDF", "TAF"],
}

# --- fixed values: table row labels ------------------------------------------------------
RISK_TABLE_LABELS = {
    "abnormal_bmd": "Abnormal BMD, n (%)",
    "age_group": "Age group",
    "cdcc_lowvl": "Prior CDC C,\nCD4% 200 cells/ul\nor <20%",
    "TDF_exp": "Any TDF exposure",
    "ART_reg": "Current ART regimen",
    "fam_hx_bone_disease": "Family history\nof bone disease",
    "PA": "Physical activity level",
    "reduced_mobility": "Reduced mobilisation",
    "bmi_cat": "BMI category",
    "smoke": "Current smoker",
    "ever_smoke": "Ever smoked",
    "alcohol": "Drinks alcohol",
    "abnormal_vitD": "Vitamin D (nmol/L)",
    "high_PTH": "PTH (pmol/L)",
    "TAF_duration": "Duration on TAF (median IQR)",
}

MISSING_AUDIT_COLUMNS = [
    "abnormal_bmd", "age_group", "CDC_C", "TDF_exp", "ART_reg", "fam_hx_bone_disease", "PA",
    "reduced_mobility", "bmi_cat", "smoke", "alcohol", "abnormal_vitD", "high_PTH",
]
NOT_A_VALUE = ("NR", "ND", "select y/n")


def drug_class_table(spark: SparkSession) -> DataFrame:
    """``drug_class(code, class)``: fixed size, safe to broadcast."""
    rows = [(code, cls) for cls, codes in DRUG_CLASSES.items() for code in codes]
    return spark.createDataFrame(rows, "code string, class string")


def levels_table(spark: SparkSession, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """``levels(variable, level, ord)``: the declared order of every factor, reference first."""
    rows = [(v, lv, i) for v, lvs in (levels or LEVELS).items() for i, lv in enumerate(lvs)]
    return spark.createDataFrame(rows, "variable string, level string, ord int")
