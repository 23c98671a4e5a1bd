"""Fixed values that results must agree on."""

#: Spellings of system organ classes under their canonical names.
ORGAN_CLASSES = {
    "Gastrointestinal Disorders": ["gastro-intestinal disorders", "gastrointestinal disorders", "gastrointestinal"],
    "Skin and Subcutaneous Tissue Disorders": [
        "skin and subcutaneous tissues disorders",
        "skin and subcutaneous tissue disorders",
        "skin and subcutaneous system disorders",
        "skin and appendages",
    ],
    "Nervous System Disorders": ["nervous system disorders", "nervous system", "nervous system disorder"],
    "Psychiatric Disorders": ["psychiatric disorders"],
    "Cardiac Disorders": ["cardiac disorders", "cardiovascular"],
    "General Disorders and Administration Site Conditions": ["general disorders and administration site conditions"],
    "Eye Disorders": ["eye disorders"],
    "Vascular Disorders": ["vascular disorders"],
    "Blood and Lymphatic System Disorders": [
        "blood and lymphatic system disorders",
        "blood and the lymphatic system disorders",
        "blood and lymphatic disorders",
    ],
    "Hepatobiliary Disorders": ["hepatobiliary disorders", "hepato-biliary disorders", "hepatic"],
    "Renal and Urinary Disorders": ["renal and urinary disorders", "renal and urinary", "renal and urinary tract disorders"],
    "Investigations": ["investigations", "laboratory and other examinations"],
    "Musculoskeletal and Connective Tissue Disorders": [
        "musculoskeletal and connective tissue disorders",
        "musculo-skeletal and connective tissue disorders",
        "musculoskeletal, connective tissue and bone disorders",
        "musculoskeletal connective tissue and bone disorders",
    ],
    "Immune System Disorders": ["immune system disorders"],
    "Metabolism and Nutrition Disorders": [
        "metabolism and nutrition disorders",
        "metabolism and nutritional disorders",
        "metabolic and nutrition disorders",
        "metabolism and nutrition system disorders",
        "electrolyte and acid-base disorders",
    ],
    "Reproductive System and Breast Disorders": ["reproductive system and breast disorders"],
    "Respiratory, Thoracic and Mediastinal Disorders": [
        "respiratory, thoracic and mediastinal disorders",
        "respiratory, thoracic, and mediastinal disorders",
        "respiratory thoracic and mediastinal disorders",
        "respiratory, thoracic and mediastinal disorder",
        "respiratory system disorders",
        "respiratory",
    ],
    "Infections and Infestations": ["infections and infestations", "infections"],
    "Ear and Labyrinth Disorders": ["ear and labyrinth disorders"],
    "Endocrine Disorders": ["endocrine disorders"],
    "Injury, Poisoning and Procedural Complications": ["injury, poisoning and procedural complications"],
    "Neoplasms Benign, Malignant and Unspecified": [
        "neoplasms benign, malignant and unspecified (incl cysts and polyps)",
        "neoplasms benign, malignant and unspecified",
    ],
    "Pregnancy, Puerperium and Perinatal Conditions": ["pregnancy, puerperium and perinatal conditions"],
    "Not Known": ["not known", "not specified", "not applicable"],
    "Social Circumstances": ["social circumstances"],
    "Surgical and Medical Procedures": ["surgical and medical procedures"],
    "Congenital, Familial and Genetic Disorders": ["congenital, familial and genetic disorders"],
    "Product Issues": ["product issues"],
}

#: Active ingredients of the pilot products.
INGREDIENTS = {
    "120": "eplerenone",
    "503": "oxycodone, naloxone",
    "1945": "sodium cromoglicate",
    "2602": "ciclosporin",
    "2648": "labetalol",
    "3815": "oxcarbazepine",
    "3887": "methylphenidate",
    "3904": "gadoxetate disodium",
    "4732": "perindopril",
    "6554": "gentamicin, hydrocortisone",
    "7484": "quetiapine",
    "7700": "morphine",
    "7708": "oxycodone, naloxone",
    "7867": "rabeprazole",
    "8137": "ibuprofen",
    "9280": "oxycodone",
    "9321": "ibuprofen",
    "9715": "budesonide",
    "9765": "dorzolamide, timolol",
    "10060": "riluzole",
    "10309": "pregabalin",
    "10334": "atomoxetine",
    "10419": "melatonin",
    "10555": "isotretinoin",
    "10560": "coagulation factor x",
    "10755": "pregabalin",
    "11053": "olanzapine",
    "11509": "adenosine",
    "11906": "ozanimod",
    "13261": "sotalol",
    "13596": "sodium valproate",
    "13659": "efavirenz, emtricitabine, tenofovir disoproxil",
    "13689": "amoxicillin",
    "13742": "fesoterodine",
    "13936": "testosterone",
    "14210": "amlodipine, valsartan",
    "14563": "montelukast",
    "14749": "lercanidipine",
    "14799": "solifenacin, tamsulosin",
    "14804": "iodixanol",
    "15886": "sulfasalazine",
    "15960": "albumin, human",
    "16018": "ibuprofen",
    "100179": "ganciclovir",
    "100626": "bosutinib",
    "100689": "famotidine",
    "100725": "mirtazapine",
    "100999": "loperamide",
    "101803": "venlafaxine",
    "101979": "cladribine",
}

#: ATC codes that win over looked-up ones.
ATC_OVERRIDES = {
    "1945": "R01AC01",
    "3904": "V08CA10",
    "13596": "N03AG01",
    "15960": "B05AA01",
    "8137": "M01AE01",
    "9321": "M01AE01",
    "16018": "M01AE01",
}

#: The graph's schema (name, domain, range, label).
CLASSES = [
    ("Drug", "Drug"),
    ("AdverseDrugReaction", "Adverse Drug Reaction"),
    ("DrugAdrOccurrence", "Drug ADR Occurrence"),
    ("SmPCDocument", "SmPC document"),
]
OBJECT_PROPERTIES = [
    ("hasOccurrence", "Drug", "DrugAdrOccurrence", "has occurrence"),
    ("occurrenceOfAdr", "DrugAdrOccurrence", "AdverseDrugReaction", "occurrence of ADR"),
    ("refersToSmPC", "DrugAdrOccurrence", "SmPCDocument", "refers to SmPC"),
]
DATA_PROPERTIES = [
    ("productId", None, "product id"),
    ("drugLabel", "Drug", "drug label"),
    ("atcCode", "Drug", "ATC code"),
    ("activeIngredient", "Drug", "active ingredient"),
    ("adrLabel", "AdverseDrugReaction", "ADR label"),
    ("meddraPreferredTerm", "AdverseDrugReaction", "MedDRA preferred term"),
    ("meddraCode", "AdverseDrugReaction", "MedDRA code"),
    ("icdCode", "AdverseDrugReaction", "ICD code"),
    ("frequency", "DrugAdrOccurrence", "frequency"),
    ("soc", "DrugAdrOccurrence", "system organ class"),
    ("sourceUrl", "SmPCDocument", "source URL"),
]
NAMESPACE = "http://example.org/pilot-smpc-kg"
GRAPH_LABEL = "SmPC Pilot ADR Knowledge Graph (Custom Ontology)"
