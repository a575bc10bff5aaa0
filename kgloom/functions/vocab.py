"""Type and relation names, rules and word lists that decide results."""

# extraction-side types; applicants stay apart
TYPE_ALIASES = {
    "organization": "company", "org": "company", "brand": "company", "manufacturer": "company", "supplier": "company", "customer": "company",
    "country": "location", "facility": "location", "manufacturing_location": "location", "manufacturinglocation": "location",
    "test_record": "test", "testrecord": "test",
}

# graph-side types; an applicant is a company there
GRAPH_TYPE_ALIASES = {
    "applicant": "company", "organization": "company", "org": "company", "brand": "company", "manufacturer": "company", "supplier": "company", "customer": "company",
    "certificate": "certification", "test_record": "test", "testrecord": "test", "filenumber": "file_number", "testplan": "test_plan",
    "manufacturinglocation": "location", "manufacturing_location": "location",
}

# in the order in which mentions are resolved
CANONICAL_TYPES = (
    "ul", "company", "product", "model", "component", "standard", "clause", "certification", "test", "test_plan",
    "file_number", "volume", "section", "deliverable", "requirement", "location", "address",
)

# canonical relation: its other names
RELATION_NAMES = {
    "party_role_applicant": ("has_applicant",),
    "has_product": ("produces", "produce", "produced_by", "makes"),
    "has_model": ("model_of",),
    "contains": ("contains_component", "has_component", "part_of"),
    "complies_with": ("evaluated_against", "subject_to", "applicable_to", "applicable_standard", "governed_by"),
    "has_certification": (),
    "party_role_manufacturer": ("manufactured_by", "manufactures", "manufacture", "manufactures_for"),
    "party_role_supplier": ("supplied_by", "supplies", "supplies_to"),
    "has_location": ("has_manufacturing_location", "located_in", "based_in"),
    "has_clause": ("has_relevant_clause",),
    "requires_test": ("has_test", "has_test_record"),
    "has_test_plan": (),
    "has_file_number": (),
    "has_volume": (),
    "has_deliverable": (),
    "has_address": (),
}
RELATION_ALIASES = {alias: name for name, others in RELATION_NAMES.items() for alias in others}

RULES = (
    ("ul", "party_role_applicant", "applicant"),
    ("applicant", "has_product", "product"),
    ("company", "has_product", "product"),
    ("product", "has_model", "model"),
    ("model", "contains", "component"),
    ("component", "complies_with", "standard"),
    ("component", "has_certification", "certification"),
    ("component", "party_role_manufacturer", "company"),
    ("company", "party_role_supplier", "applicant"),
    ("company", "party_role_supplier", "company"),
    ("company", "has_location", "location"),
    ("standard", "has_clause", "clause"),
    ("standard", "has_certification", "certification"),
    ("certification", "requires_test", "test"),
    ("certification", "has_test_plan", "test_plan"),
    ("certification", "has_file_number", "file_number"),
    ("certification", "has_volume", "volume"),
    ("certification", "has_deliverable", "deliverable"),
    ("location", "has_address", "address"),
)

LEGAL_SUFFIXES = (
    "incorporated", "corporation", "company", "limited", "gmbh", "ag", "inc", "llc", "ltd", "corp",
    "co", "plc", "lp", "sa", "sas", "bv", "nv", "oy", "ab", "kg",
)

GENERIC_ORG_WORDS = (
    "electronics electronic technologies technology tech international industries industrial industry systems system solutions solution group groups "
    "holdings holding manufacturing products product services service enterprises enterprise global worldwide software hardware communications "
    "communication devices device motors motor computers computer semiconductors semiconductor"
).split()

WEAK_COMPANY_WORDS = (
    "general united american national international pacific atlantic global first standard new north south east west advanced universal digital smart "
    "micro mega great best super city state"
).split()

UL_NAMES = ("ul solutions", "ul", "ul llc")

# path: root label, hops (relation, outgoing)
LINEAGE_PATHS = {
    "models": ("product", (("HAS_MODEL", True),)),
    "components": ("product", (("HAS_MODEL", True), ("CONTAINS", True))),
    "standards": ("product", (("HAS_MODEL", True), ("CONTAINS", True), ("COMPLIES_WITH", True))),
    "certifications": ("product", (("HAS_MODEL", True), ("CONTAINS", True), ("HAS_CERTIFICATION", True))),
    "certification_files": ("product", (("HAS_MODEL", True), ("CONTAINS", True), ("HAS_CERTIFICATION", True), ("HAS_FILE_NUMBER", True))),
    "component_manufacturers": ("product", (("HAS_MODEL", True), ("CONTAINS", True), ("PARTY_ROLE_MANUFACTURER", True))),
    "owner_company": ("product", (("HAS_PRODUCT", False),)),
    "company_products": ("company", (("HAS_PRODUCT", True),)),
    "company_suppliers": ("company", (("PARTY_ROLE_SUPPLIER", True),)),
    "company_locations": ("company", (("HAS_LOCATION", True),)),
    "standard_components": ("standard", (("COMPLIES_WITH", False),)),
    "ul_applicants": ("ul", (("PARTY_ROLE_APPLICANT", True),)),
}

# tier of each type on display; others are 6
TIERS = {"ul": 1, "company": 1, "location": 2, "certification": 2, "address": 3, "file_number": 3, "deliverable": 3, "product": 3, "volume": 4, "model": 4, "section": 5, "component": 6, "standard": 7, "test_plan": 7, "clause": 8, "test": 9}

# fixed values: names of types in extraction responses, and the types that are known there
EXTRACTION_ALIASES = {
    "organization": "company", "org": "company", "manufacturer": "company", "supplier": "company", "customer": "company", "brand": "company",
    "part": "component", "assembly": "component", "subassembly": "component", "bom": "component", "spec": "standard", "regulation": "standard",
    "article": "clause", "cert": "certification", "testing": "test", "test_record": "test", "testrecord": "test", "filenumber": "file_number",
    "testplan": "test_plan", "manufacturinglocation": "location", "manufacturing_location": "location", "ulsolutions": "ul", "ul_solutions": "ul",
}
EXTRACTION_TYPES = (
    "ul", "applicant", "product", "model", "component", "standard", "clause", "certification", "test", "test_plan",
    "file_number", "volume", "section", "deliverable", "company", "location", "address",
)
# fixed values: caps of one extraction response
MOST_ENTITIES, MOST_RECORDS = 40, 80
# fixed values: words that speak for a role
APPLICANT_CUES = r"(?i)\b(applicants?|listee|certificate holder|party[\s_-]*role[\s_-]*applicant|filed(\s+an)?\s+application|submitted(\s+an)?\s+application|application\s+(for|to)\s+(ul|listing|certification))\b"
MANUFACTURER_CUES = r"(?i)\b(manufactured\s+by|manufacturer(s)?(\s+of)?|manufactures|manufactured\s+at)\b"

# fixed values: single words that are no company, beginnings of standards' numbers, what ends the name in a rights line
UNNAMED_WORDS = (
    "all", "this", "these", "the", "our", "its", "their", "documentation", "privacy", "terms", "support", "introduction", "contents", "copyright", "india", "united",
    "international", "institute", "standard", "safety",
)
NUMBERED_BODIES = r"(?i)^(?:ul|iec|iso|csa|en|ieee|ansi|un|astm)\s*[0-9]"
RIGHTS = r"(?i)(?:\s+all rights reserved|\s+privacy policy|\s+terms of use).*$"
# fixed values: legal forms that a firm's name may have at its end in a text
_FORM = r"(?:Inc|Incorporated|Corp|Corporation|Co|Company|Ltd|Limited|LLC|LLP|PLC|GmbH|AG|SA|SAS|BV|NV|Oy|AB|KK|Pty)\.?"
_FIRM = r"[A-Z][A-Za-z0-9&'’\-]+"
#: Phrases that name a firm, as (kind, flags, phrase with the name as its group, what must follow).
FIRM_CUES = (
    ("copyright", "i", rf"copyright\s*(?:©|\(c\)|&copy;)?\s*(?:\d{{4}}\s*[-–—]\s*)?(?:\d{{4}}[^\S\n]+)?({_FIRM}(?:[^\S\n]+{_FIRM}|[^\S\n]+{_FORM}){{0,6}})", r"[^\S\n]*\.|[^\S\n]+all rights reserved|\s*$"),
    ("testing_by", "i", rf"testing conducted by[^\S\n]+({_FIRM}(?:[^\S\n]+{_FORM})?)", ""),
    ("products", "", rf"\b({_FIRM}(?:[^\S\n]+{_FORM})?)[^\S\n]+products\b", ""),
    ("support", "", rf"\b({_FIRM})[^\S\n]+Support[^\S\n]*\(", ""),
)
# fixed values: legal forms that don't tell firms apart
CORE_SUFFIXES = (
    "incorporated", "corporation", "limited", "gmbh", "pllc", "pvt ltd", "pty ltd", "s a s", "s a", "llc", "llp", "pty", "plc", "corp", "inc", "ltd", "pvt", "lp", "nv", "ag",
    "bv", "oy", "ab", "kk", "co", "sa", "sas",
)

# fixed values: words of a question that name an intent, and what it looks for in the graph
INTENT_TERMS = {
    "company": ("company", "companies", "manufacturer", "supplier", "brand"),
    "product": ("product", "products", "device", "devices"),
    "model": ("model", "models", "variant", "variants"),
    "component": ("component", "components", "part", "parts", "assembly"),
    "standard": ("standard", "standards", "regulation", "regulations"),
    "clause": ("clause", "clauses", "section", "sections", "requirement"),
    "certification": ("certification", "certifications", "certificate", "certified"),
    "test": ("test", "tests", "testing", "evaluation"),
    "compliance": ("compliance", "compliant", "requirement", "requirements", "required", "applicable"),
}
INTENT_LABELS = {
    "clause": ("Clause",), "standard": ("Standard",), "certification": ("Certification", "Certificate"), "test": ("Test", "TestPlan"), "component": ("Component", "Material"),
    "company": ("Company",), "product": ("Product", "Model"), "model": ("Model", "Product", "Variant"), "compliance": ("Standard", "Certification", "Clause", "Test"),
}

# fixed values: what a question's intents look for along trails: types of nodes, and relations that mark a way there
TRAIL_TARGETS = {
    "clause": (("clause",), ("HAS_CLAUSE", "COMPLIES_WITH", "SUBJECT_TO")),
    "standard": (("standard",), ("COMPLIES_WITH", "SUBJECT_TO", "HAS_CLAUSE", "REQUIRES_TEST")),
    "certification": (("certification", "certificate"), ("HAS_CERTIFICATION", "COMPLIES_WITH", "SUBJECT_TO")),
    "test": (("test", "test_plan"), ("REQUIRES_TEST", "HAS_TEST_PLAN", "COMPLIES_WITH")),
    "component": (("component", "material"), ("CONTAINS", "COMPLIES_WITH")),
    "company": (("company",), ("PARTY_ROLE_APPLICANT", "PARTY_ROLE_MANUFACTURER", "PARTY_ROLE_SUPPLIER", "HAS_PRODUCT")),
    "product": (("product", "model"), ("HAS_PRODUCT", "HAS_MODEL", "CONTAINS")),
    "model": (("model", "product", "variant"), ("HAS_MODEL", "CONTAINS", "COMPLIES_WITH")),
    "compliance": (("standard", "certification", "clause", "test"), ("COMPLIES_WITH", "SUBJECT_TO", "HAS_CERTIFICATION", "HAS_CLAUSE", "REQUIRES_TEST")),
}
# fixed values: relations that trails may use
TRAIL_RELATIONS = (
    "HAS_PRODUCT", "HAS_MODEL", "CONTAINS", "COMPLIES_WITH", "SUBJECT_TO", "REQUIRES_TEST", "HAS_CERTIFICATION", "HAS_TEST_PLAN", "HAS_FILE_NUMBER", "HAS_VOLUME",
    "HAS_DELIVERABLE", "HAS_CLAUSE", "PARTY_ROLE_APPLICANT", "PARTY_ROLE_MANUFACTURER", "PARTY_ROLE_SUPPLIER", "HAS_LOCATION", "HAS_ADDRESS",
)
# fixed values: words of a question about relations, an intent of its own where questions are understood but no target of trails
RELATION_TERMS = ("relationship", "relationships", "associated", "connected", "contain", "contains", "produces", "applies", "between")
#: Intents of a question in their order, that one included.
UNDERSTOOD_TERMS = {k: v for k, v in INTENT_TERMS.items() if k != "compliance"} | {"relationships": RELATION_TERMS, "compliance": INTENT_TERMS["compliance"]}
# fixed values: words of a question that are no keywords
STOP_WORDS = (
    "a", "about", "all", "an", "and", "are", "as", "associated", "at", "be", "between", "by", "can", "contain", "contains", "do", "does", "for", "from", "has", "have", "how",
    "in", "information", "is", "it", "me", "of", "on", "present", "show", "that", "the", "this", "to", "what", "when", "where", "which", "why", "with",
)

# fixed values: words that tell models of one line apart
VARIANT_MARKS = ("ultra", "plus", "pro", "max", "mini", "lite", "se", "fe", "edge", "note")
# fixed values: bodies whose designations are no part numbers
STANDARD_BODIES = ("ul", "iec", "iso", "ieee", "csa", "en", "ansi", "astm")
