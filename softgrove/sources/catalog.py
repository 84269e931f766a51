"""Table catalogue: named recipes (source files, read options, columns,
missing-value rules, label rule, categorical columns) run by ONE generic
DataFrame program, ``prepare_table``.

Column names are fixed values: they must equal the original files' layouts
to read them. Files are looked up under ``data_root`` (land them there
first; nothing is fetched over the network).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softgrove.functions.columns import column_range
from softgrove.operators import clean
from softgrove.operators._util import qcol
from softgrove.operators.labels import encode_label
from softgrove.sources.tables import read_table, with_row_id, zip_by_position


@dataclass
class TableSpec:
    name: str
    files: list[str]
    columns: list[str] | None
    label: str  # source column of the label
    label_rule: str = "codes"  # codes | predicate | passthrough
    predicate: object = None  # callable(col) -> Column for label_rule="predicate"
    null_as: int = 0
    sep: str = ","
    header: bool = False
    null_token: str | None = None
    comment: str | None = None
    drop: list[str] = field(default_factory=list)
    select: list[str] | None = None  # feature columns, in order (default: all but label and drop)
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] | None = None  # columns cast to double (default: non-categorical features)
    impute: list[tuple] = field(default_factory=list)  # (rule, kwargs)
    positions: tuple | None = None  # (column, n, names) for a fixed-length string
    xy: bool = False  # features and labels in two files paired by position


# ---------------------------------------------------------------------------
# Column layouts of the shipped tables.
IRIS = ["sepal_length", "sepal_width", "petal_length", "petal_width", "class"]
WDBC = ["ID number", "Diagnosis", "radius", "texture", "perimeter", "area", "smoothness", "compactness",
        "concavity", "concave points", "symmetry", "fractal dimension"]
HEART = ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach", "exang", "oldpeak", "slope",
         "ca", "thal", "num"]
MUSHROOM = ["eadible", "cap-shape", "cap-surface", "cap-color", "ruises?", "odor", "gill-attachment",
            "gill-spacing", "gill-size", "gill-color", "stalk-shape", "stalk-root", "stalk-surface-above-ring",
            "stalk-surface-below-ring", "stalk-color-above-ring", "stalk-color-below-ring", "veil-type",
            "veil-color", "ring-number", "ring-type", "spore-print-color", "population", "habitat"]
VOTING = ["Class Name", "handicapped-infants", "water-project-cost-sharing", "adoption-of-the-budget-resolution",
          "physician-fee-freeze", "el-salvador-aid", "religious-groups-in-schools", "anti-satellite-test-ban",
          "aid-to-nicaraguan-contras", "mx-missile", "immigration", "synfuels-corporation-cutback",
          "education-spending", "superfund-right-to-sue", "crime", "duty-free-exports",
          "export-administration-act-south-africa"]
HEPATITIS = ["Class", "AGE", "SEX", "STEROID", "ANTIVIRALS", "FATIGUE", "MALAISE", "ANOREXIA", "LIVER BIG",
             "LIVER FIRM", "SPLEEN PALPABLE", "SPIDERS", "ASCITES", "VARICES", "BILIRUBIN", "ALK PHOSPHATE",
             "SGOT", "ALBUMIN", "PROTIME", "HISTOLOGY"]
HEPATITIS_CAT = ["SEX", "STEROID", "ANTIVIRALS", "FATIGUE", "MALAISE", "ANOREXIA", "LIVER BIG", "LIVER FIRM",
                 "SPLEEN PALPABLE", "SPIDERS", "ASCITES", "VARICES", "HISTOLOGY"]
ECHO = ["survival", "still-alive", "age-at-heart-attack", "pericardial-effusion", "fractional-shortening",
        "epss", "lvdd", "wall-motion-score", "wall-motion-index", "mult", "name", "group", "alive-at-1"]
GLASS = ["Id number", "RI", "Na", "Mg", "Al", "Si", "K", "Ca", "Ba", "Fe", "Type of glass"]
WINE = ["Alcohol", "Malic acid", "Ash", "Alcalinity of ash", "Magnesium", "Total phenols", "Flavanoids",
        "Nonflavanoid phenols", "Proanthocyanins", "Color intensity", "Hue", "OD280/OD315 of diluted wines",
        "Proline"]
BALANCE = ["Class Name", "Left-Weight", "Left-Distance", "Right-Weight", "Right-Distance"]
CAR = ["buying", "maint", "doors", "persons", "lug_boot", "safety", "class"]
ZOO = ["animal name", "hair", "feathers", "eggs", "milk", "airborne", "aquatic", "predator", "toothed",
       "backbone", "breathes", "venomous", "fins", "legs", "tail", "domestic", "catsize", "type"]
CMC = ["Wife's age", "Wife's education", "Husband's education", "Number of children ever born",
       "Wife's religion", "Wife's now working?", "Husband's occupation", "Standard-of-living index",
       "Media exposure", "Contraceptive method used"]
GERMAN = ["Status of existing checking account", "Duration in month", "Credit history", "Purpose",
          "Credit amount", "Savings account/bonds", "Present employment since",
          "Installment rate in percentage of disposable income", "Personal status and sex",
          "Other debtors / guarantors", "Present residence since", "Property", "Age in years",
          "Other installment plans", "Housing", "Number of existing credits at this bank", "Job",
          "Number of people being liable to provide maintenance for", "Telephone", "foreign worker", "label"]
GERMAN_CAT = ["Status of existing checking account", "Credit history", "Purpose", "Savings account/bonds",
              "Present employment since", "Personal status and sex", "Other debtors / guarantors", "Property",
              "Other installment plans", "Housing", "Job", "Telephone", "foreign worker"]
SPLICE = ["One of {n ei ie}", "instance name", "sequence"]
COLIC = ["surgery", "Age", "Hospital Number", "rectal temperature", "pulse", "respiratory rate",
         "temperature of extremities", "peripheral pulse", "mucous membranes", "capillary refill time", "pain",
         "peristalsis", "abdominal distension", "nasogastric tube", "nasogastric reflux", "nasogastric reflux PH",
         "rectal examination", "abdomen", "packed cell volume", "total protein", "abdominocentesis appearance",
         "abdomcentesis total protein", "outcome", "surgical lesion?", "type of lesion1", "type of lesion2",
         "type of lesion3", "cp_data"]
COLIC_CAT = ["temperature of extremities", "peripheral pulse", "mucous membranes", "capillary refill time", "pain",
             "peristalsis", "abdominal distension", "nasogastric tube", "nasogastric reflux", "rectal examination",
             "abdomen", "abdominocentesis appearance", "type of lesion1", "type of lesion2", "type of lesion3"]
FLARE = ["Code for class", "Code for largest spot size", "Code for spot distribution", "Activity", "Evolution",
         "Previous 24 hour flare activity code", "Historically-complex",
         "Did region become historically complex on this pass across the suns disk", "Area",
         "Area of the largest spot",
         "C-class flares production by this region in the following 24 hours (common flares)",
         "M-class flares production by this region in the following 24 hours (moderate flares)",
         "X-class flares production by this region in the following 24 hours (severe flares)"]
SEGMENT = ["target", "region-centroid-col", "region-centroid-row", "region-pixel-count", "short-line-density-5",
           "short-line-density-2", "vedge-mean", "vegde-sd", "hedge-mean", "hedge-sd", "intensity-mean",
           "rawred-mean", "rawblue-mean", "rawgreen-mean", "exred-mean", "exblue-mean", "exgreen-mean",
           "value-mean", "saturatoin-mean", "hue-mean"]
DERMATOLOGY = ["erythema", "scaling", "definite borders", "itching", "koebner phenomenon", "polygonal papules",
               "follicular papules", "oral mucosal involvement", "knee and elbow involvement", "scalp involvement",
               "family history", "melanin incontinence", "eosinophils in the infiltrate", "PNL infiltrate",
               "fibrosis of the papillary dermis", "exocytosis", "acanthosis", "hyperkeratosis", "parakeratosis",
               "clubbing of the rete ridges", "elongation of the rete ridges",
               "thinning of the suprapapillary epidermis", "spongiform pustule", "munro microabcess",
               "focal hypergranulosis", "disappearance of the granular layer",
               "vacuolisation and damage of basal layer", "spongiosis", "saw-tooth appearance of retes",
               "follicular horn plug", "perifollicular parakeratosis", "inflammatory monoluclear inflitrate",
               "band-like infiltrate", "Age (linear)", "diagnosis"]
ANNEAL = ["family", "product-type", "steel", "carbon", "hardness", "temper_rolling", "condition", "formability",
          "strength", "non-ageing", "surface-finish", "surface-quality", "enamelability", "bc", "bf", "bt", "bw/me",
          "bl", "m", "chrom", "phos", "cbond", "marvi", "exptl", "ferro", "corr", "blue/bright/varn/clean", "lustre",
          "jurofm", "s", "p", "shape", "thick", "width", "len", "oil", "bore", "packing", "classes"]
ANNEAL_NUMERIC = ["carbon", "hardness", "strength", "thick", "width", "len"]
LYMPH = ["class", "lymphatics", "block of affere", "bl. of lymph. c", "bl. of lymph. s", "by pass", "extravasates",
         "regeneration of", "early uptake in", "lym.nodes dimin", "lym.nodes enlar", "changes in lym.",
         "efect in node", "changes in node", "changes in stru", "special forms", "dislocation of",
         "exclusion of no", "no. of nodes in"]
LYMPH_CAT = ["lymphatics", "lym.nodes dimin", "lym.nodes enlar", "changes in lym.", "efect in node",
             "changes in node", "changes in stru", "special forms"]
HEART_FAILURE_LABEL = "DEATH_EVENT"
CERVICAL = ["Age", "Number of sexual partners", "First sexual intercourse", "Num of pregnancies", "Smokes",
            "Smokes (years)", "Hormonal Contraceptives", "Hormonal Contraceptives (years)", "IUD", "IUD (years)",
            "STDs", "STDs (number)", "STDs:condylomatosis", "STDs:cervical condylomatosis",
            "STDs:vaginal condylomatosis", "STDs:vulvo-perineal condylomatosis", "STDs:syphilis",
            "STDs:pelvic inflammatory disease", "STDs:genital herpes", "STDs:molluscum contagiosum", "STDs:AIDS",
            "STDs:HIV", "STDs:Hepatitis B", "STDs:HPV", "STDs: Number of diagnosis",
            "STDs: Time since first diagnosis", "STDs: Time since last diagnosis", "Dx:Cancer", "Dx:CIN", "Dx:HPV",
            "Dx"]
CERVICAL_TOKEN_KEPT = ["Number of sexual partners", "First sexual intercourse", "Num of pregnancies", "Smokes",
                       "Smokes (years)", "Hormonal Contraceptives", "Hormonal Contraceptives (years)", "IUD",
                       "IUD (years)", "STDs", "STDs (number)", "STDs:condylomatosis",
                       "STDs:cervical condylomatosis", "STDs:vaginal condylomatosis",
                       "STDs:vulvo-perineal condylomatosis", "STDs:syphilis", "STDs:pelvic inflammatory disease",
                       "STDs:genital herpes", "STDs:molluscum contagiosum", "STDs:AIDS", "STDs:HIV",
                       "STDs:Hepatitis B", "STDs:HPV", "Dx:Cancer", "Dx:CIN", "Dx:HPV", "Dx"]
CERVICAL_TOKEN_EXCLUDED = ["STDs: Time since first diagnosis", "STDs: Time since last diagnosis"]
ABSENTEEISM = ["Seasons", "Day of the week", "Month of absence", "Disciplinary failure", "Social drinker",
               "Social smoker", "Transportation expense", "Distance from Residence to Work", "Service time", "Age",
               "Work load Average/day ", "Hit target", "Education", "Son", "Pet", "Weight", "Height",
               "Body mass index"]
ADULT = ["Age", "Workclass", "fnlwgt", "Education", "Education-Num", "Marital Status", "Occupation",
         "Relationship", "Race", "Sex", "Capital Gain", "Capital Loss", "Hours per week", "Country", "capital_gain"]
ADULT_CAT = ["Workclass", "Education", "Marital Status", "Occupation", "Relationship", "Race", "Sex", "Country"]
ADULT_ORDER = ["Sex", "Race", "Workclass", "Age", "fnlwgt", "Education", "Education-Num", "Marital Status", "Occupation",
               "Relationship", "Capital Gain", "Capital Loss", "Hours per week", "Country"]
TITANIC = ["Sex", "Embarked", "Pclass", "Age", "SibSp", "Parch", "Fare"]
LOAN = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "ApplicantIncome", "CoapplicantIncome",
        "LoanAmount", "Loan_Amount_Term", "Credit_History", "Property_Area"]
LOAN_CAT = ["Gender", "Married", "Dependents", "Education", "Self_Employed", "Property_Area"]
BANK = ["age", "job", "marital", "education", "default", "housing", "loan", "contact", "month", "day", "campaign",
        "pdays", "previous", "poutcome"]
BANK_CAT = ["job", "marital", "education", "default", "housing", "loan", "contact", "month", "day", "campaign",
            "pdays", "poutcome"]
THYROID = ["age", "sex", "on thyroxine", "query on thyroxine", "on antithyroid medication", "sick", "pregnant",
           "thyroid surgery", "I131 treatment", "query hypothyroid", "query hyperthyroid", "lithium", "goitre",
           "tumor", "hypopituitary", "psych", "TSH measured", "TSH", "T3 measured", "T3", "TT4 measured", "TT4",
           "T4U measured", "T4U", "FTI measured", "FTI", "TBG measured", "TBG", "referral source", "class"]
THYROID_NUMERIC = ["age", "TSH", "T3", "TT4", "T4U", "FTI", "TBG"]
BANKNOTE = ["variance", "skewness", "curtosis", "entropy", "class"]
XY_TABLES = ["ISOLET", "letter_recognition", "mnist", "pen_digits", "semeion"]
# Tables of a public archive that is reached over the network: land a file of
# the features and one of the target of each, with their header lines.
LANDED_XY_TABLES = ["WisconsinBreastCancer", "Wine", "Ecoli", "Yeast", "Statlog", "MAGIC", "Fertility",
                    "user knowledge", "wholesaleCustomer", "HTRU2", "Phishing", "iranian"]
# Sheets: land them as CSV.
SHEET_TABLES = {"BIN:Raisins": "Raisins/Raisin_Dataset.csv", "Rice": "Rice/Rice_Cammeo_Osmancik.csv"}
# ---------------------------------------------------------------------------

# Spambase: 48 word frequencies, 6 character frequencies, 3 capital-run measures.
SPAMBASE = (column_range("word_freq_WORD_", 48) + column_range("char_freq_CHAR_", 6)
            + ["capital_run_length_average", "capital_run_length_longest", "capital_run_length_total",
               "spam_type"])
# Landsat: pixel-major names spectral_<band>_pixel_<pixel>, 4 bands x 9 pixels.
LANDSAT = [f"spectral_{i}_pixel_{j}" for j in range(9) for i in range(4)] + ["target"]

SPLICE_POSITIONS = [str(i) for i in range(-30, 30)]

CATALOG: dict[str, TableSpec] = {
    "Iris": TableSpec("Iris", ["Iris/iris.data"], IRIS, "class"),
    "BIN:Wisconsin Diagnostic Breast Cancer": TableSpec(
        "BIN:Wisconsin Diagnostic Breast Cancer", ["Wisconsin Diagnostic Breast Cancer/wdbc.data"], WDBC,
        "Diagnosis", drop=["ID number"]),
    "BIN:Heart Disease": TableSpec(
        "BIN:Heart Disease", ["Heart Disease/processed.cleveland.data"], HEART, "num", label_rule="predicate",
        predicate=lambda c: c.try_cast("double") < 1, categorical=["restecg", "slope", "thal", "cp"],
        impute=[("fill_mode", {"cols": HEART[:-1], "token": "?"})]),
    "Mushroom": TableSpec("Mushroom", ["Mushroom/agaricus-lepiota.data"], MUSHROOM, "eadible",
                          categorical=MUSHROOM[1:]),
    "BIN:Congressional Voting": TableSpec(
        "BIN:Congressional Voting", ["Congressional Voting/house-votes-84.data"], VOTING, "Class Name",
        categorical=VOTING[1:]),
    "BIN:Hepatitis": TableSpec("BIN:Hepatitis", ["Hepatitis/hepatitis.data"], HEPATITIS, "Class", null_token="?",
                               categorical=HEPATITIS_CAT, impute=[("fill_mode_all", {})]),
    "BIN:Echocardiogram": TableSpec(
        "BIN:Echocardiogram", ["Echocardiogram/echocardiogram.data"], ECHO, "alive-at-1", label_rule="predicate",
        predicate=lambda c: c.try_cast("double") != 0, null_as=1, null_token="?",
        drop=["survival", "still-alive", "name", "group"], impute=[("fill_mode_all", {})]),
    "BIN:Blood Transfusion": TableSpec("BIN:Blood Transfusion", ["Transfusion/transfusion.data"],
                                       ["R", "F", "M", "T", "a"], "a", header=True),
    "BIN:German": TableSpec("BIN:German", ["German/german.data"], GERMAN, "label", sep=" ", categorical=GERMAN_CAT),
    "MULT:Glass": TableSpec("MULT:Glass", ["Glass/glass.data"], GLASS, "Type of glass", drop=["Id number"]),
    "MULT:Wine": TableSpec("MULT:Wine", ["Wine/wine.data"], WINE, "Alcohol"),
    "MULT:Balance Scale": TableSpec("MULT:Balance Scale", ["Balance Scale/balance-scale.data"], BALANCE, "Class Name"),
    "MULT:Car": TableSpec("MULT:Car", ["Car/car.data"], CAR, "class", categorical=CAR[:-1]),
    "MULT:Zoo": TableSpec("MULT:Zoo", ["Zoo/zoo.data"], ZOO, "type", drop=["animal name"]),
    "MULT:Contraceptive": TableSpec(
        "MULT:Contraceptive", ["Contraceptive/cmc.data"], CMC, "Contraceptive method used",
        categorical=["Wife's education", "Husband's education", "Husband's occupation", "Standard-of-living index"]),
    "BIN:Horse Colic": TableSpec(
        "BIN:Horse Colic", ["Colic/horse-colic.data", "Colic/horse-colic.test"], COLIC, "surgical lesion?",
        sep=" ", null_token="?", drop=["Hospital Number"], categorical=COLIC_CAT, impute=[("fill_mode_all", {})]),
    "MULT:Solar Flare": TableSpec(
        "MULT:Solar Flare", ["Solar Flare/flare.data1", "Solar Flare/flare.data2"], FLARE, FLARE[10], sep=" ",
        header=True, drop=FLARE[11:], categorical=FLARE[:10]),
    "Segment": TableSpec("Segment", ["Segment/segmentation.data", "Segment/segmentation.test"], SEGMENT, "target",
                         header=True, comment=";"),
    "MULT:Landsat": TableSpec("MULT:Landsat", ["Landsat/sat.trn", "Landsat/sat.tst"], LANDSAT, "target", sep=" "),
    "MULT:Dermatology": TableSpec(
        "MULT:Dermatology", ["Dermatology/dermatology.data"], DERMATOLOGY, "diagnosis",
        impute=[("fill_mean", {"cols": ["Age (linear)"], "token": "?"})]),
    "MULT:Annealing": TableSpec("MULT:Annealing", ["Annealing/anneal.data"], ANNEAL, "classes",
                                categorical=[c for c in ANNEAL[:-1] if c not in ANNEAL_NUMERIC]),
    "MULT:Lymphography": TableSpec("MULT:Lymphography", ["Lymphography/lymphography.data"], LYMPH, "class",
                                   categorical=LYMPH_CAT),
    "BIN:Heart Failure": TableSpec(
        "BIN:Heart Failure", ["Heart Failure/heart_failure_clinical_records_dataset.csv"], None, HEART_FAILURE_LABEL,
        header=True, label_rule="predicate", predicate=lambda c: c.try_cast("double") > 0),
    "BIN:Cervical Cancer": TableSpec(
        "BIN:Cervical Cancer", ["Cervical_Cancer/risk_factors_cervical_cancer.csv"], None, "Biopsy", header=True,
        select=CERVICAL, impute=[("fill_mode", {"cols": CERVICAL_TOKEN_KEPT, "token": "?"}),
                                 ("fill_mode", {"cols": CERVICAL_TOKEN_EXCLUDED, "token": "?", "exclude_token": True})]),
    "Credit Card": TableSpec(
        "Credit Card", ["UCI_Credit_Card/UCI_Credit_Card.csv"], None, "default.payment.next.month", header=True,
        label_rule="predicate", predicate=lambda c: c.try_cast("double") < 1, drop=["ID"]),
    "BIN:Absenteeism": TableSpec(
        "BIN:Absenteeism", ["Absenteeism/absenteeism.csv"], None, "Absenteeism time in hours", sep=";", header=True,
        label_rule="predicate", predicate=lambda c: c.try_cast("double") > 4, select=ABSENTEEISM,
        categorical=["Seasons", "Month of absence", "Education"]),
    "Adult": TableSpec("Adult", ["Adult/adult.data"], ADULT, "capital_gain", label_rule="predicate", select=ADULT_ORDER,
                       predicate=lambda c: c != " <=50K", null_as=1, categorical=ADULT_CAT),
    "BIN:Titanic": TableSpec(
        "BIN:Titanic", ["Titanic/train.csv"], None, "Survived", header=True, label_rule="passthrough",
        select=TITANIC, categorical=["Embarked", "Sex", "Pclass"],
        impute=[("fill_mean", {"cols": ["Age", "Fare"]}), ("fill_const", {"values": {"Embarked": "S"}})]),
    "BIN:Loan House": TableSpec(
        "BIN:Loan House", ["Loan/loan-train.csv"], None, "Loan_Status", header=True, label_rule="predicate",
        predicate=lambda c: c == "Y", select=LOAN, categorical=LOAN_CAT,
        impute=[("fill_mode", {"cols": ["Gender", "Dependents", "Married", "Self_Employed"]}),
                ("fill_mean", {"cols": ["LoanAmount", "Loan_Amount_Term", "Credit_History"]})]),
    "Bank Marketing": TableSpec("Bank Marketing", ["Bank Marketing/bank-full.csv"], None, "y", sep=";", header=True,
                                select=BANK, categorical=BANK_CAT),
    "BIN:Thyroid": TableSpec(
        "BIN:Thyroid", ["Thyroid/thyroid0387.data"], THYROID, "class", null_token="?", label_rule="predicate",
        predicate=lambda c: c.contains("-"), categorical=[c for c in THYROID[:-1] if c not in THYROID_NUMERIC],
        impute=[("fill_mode_all", {})]),
    "BIN:Banknote Authentication": TableSpec(
        "BIN:Banknote Authentication", ["Banknote/data_banknote_authentication.txt"], BANKNOTE, "class"),
    "Spambase": TableSpec("Spambase", ["Spambase/spambase.data"], SPAMBASE, "spam_type"),
    **{name: TableSpec(name, [f"{name}/X_{name}.csv", f"{name}/y_{name}.csv"], None, "class", header=True,
                       xy=True) for name in XY_TABLES + LANDED_XY_TABLES},
    **{name: TableSpec(name, [path], None, "Class", header=True) for name, path in SHEET_TABLES.items()},
    "Splice": TableSpec("Splice", ["Splice/splice.data"], SPLICE, "One of {n ei ie}", drop=["instance name"],
                        positions=("sequence", 60, SPLICE_POSITIONS), categorical=SPLICE_POSITIONS),
}


def prepare_table(spark: SparkSession, spec: TableSpec | str, data_root: str) -> tuple[DataFrame, list[str], list[str]]:
    """Read and clean one catalogue table. Returns the table
    ``(row_id, <features>, label)``, the feature columns in order, and the
    categorical ones. Unknown names raise ``ValueError``."""
    if isinstance(spec, str):
        if spec not in CATALOG:
            raise ValueError(f"Unknown key: {spec}")
        spec = CATALOG[spec]
    paths = [f"{data_root.rstrip('/')}/{f}" for f in spec.files]
    if spec.xy:
        x = read_table(spark, paths[0], header=True, sep=spec.sep)
        y = read_table(spark, paths[1], header=True, sep=spec.sep)
        y = y.select(qcol(y.columns[0]).alias(spec.label))
        df = zip_by_position(x, y)
    else:
        df = None
        for p in paths:
            d = read_table(spark, p, spec.columns, sep=spec.sep, header=spec.header, null_token=spec.null_token,
                           comment=spec.comment)
            df = d if df is None else df.unionByName(d)
        df = with_row_id(df)
    if spec.positions:
        col, n, names = spec.positions
        df = clean.split_positions(df, col, n, names)
    skip = set(spec.drop) | {spec.label, "row_id"}
    if spec.positions:
        skip.add(spec.positions[0])
    feats = spec.select or [c for c in df.columns if c not in skip]
    cats = [c for c in spec.categorical if c in feats]
    numeric = spec.numeric if spec.numeric is not None else [c for c in feats if c not in cats]
    # numbers before fills: modes and their ties are those of the values, not
    # of their spellings (a column with a token stays text until it is filled)
    tokens = {c for _, kw in spec.impute if kw.get("token") is not None for c in kw["cols"]}
    early = {c for c in numeric if c not in tokens} | ({spec.label} if _holds_numbers(df, spec.label) else set())
    df = df.select(*[qcol(c).try_cast("double").alias(c) if c in early else qcol(c) for c in df.columns])
    for rule, kw in spec.impute:
        if rule == "fill_mode":
            df = clean.fill_mode(df, **kw)
        elif rule == "fill_mode_all":
            df = clean.fill_mode_all(df, [c for c in df.columns if c != "row_id"])
        elif rule == "fill_mean":
            df = clean.fill_mean(df, **kw)
        elif rule == "fill_const":
            df = clean.fill_const(df, **kw)
        else:
            raise ValueError(f"unknown imputation rule {rule}")
    df = df.withColumnRenamed(spec.label, "__y")  # the source may itself be called "label"
    if spec.label_rule == "codes":
        df, _ = encode_label(df, "__y", out="label", keep=True)
    elif spec.label_rule == "predicate":
        df = clean.derive_label(df, spec.predicate(F.col("__y")), "label", spec.null_as)
    else:
        df = df.withColumn("label", F.col("__y").cast("int"))
    out = df.select("row_id", *[(qcol(c).try_cast("double").alias(c) if c in numeric else qcol(c)) for c in feats],
                    F.col("label").cast("int").alias("label"))
    return out, feats, cats


def _holds_numbers(df: DataFrame, col: str) -> bool:
    """Whether every value of a text column that isn't NULL is a number."""
    return df.where(qcol(col).isNotNull() & qcol(col).try_cast("double").isNull()).isEmpty()


__all__ = ["CATALOG", "TableSpec", "prepare_table", "column_range"]
