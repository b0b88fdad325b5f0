"""Label canonicalisation: the tables and the Column builders that apply them.

A label is looked up by its key: upper case, with hyphens and blanks as underscores. Present with a null
target (written "-") is not the same as absent.
"""

from __future__ import annotations

from functools import cache

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"
#: Maps over which the names of a table are dealt by their hash.
SLOTS = 256

# Source label -> canonical label, "-" for none.
_BASE = """
PERSON PERSON
EMAIL_ADDRESS EMAIL_ADDRESS
PHONE_NUMBER PHONE_NUMBER
LOCATION LOCATION
DATE_TIME DATE_TIME
US_SOCIAL_SECURITY_NUMBER US_SOCIAL_SECURITY_NUMBER
CREDIT_CARD_NUMBER CREDIT_CARD_NUMBER
US_PASSPORT_NUMBER US_PASSPORT_NUMBER
IP_ADDRESS IP_ADDRESS
URL URL
PASSWORD PASSWORD
DATE DATE
ADDRESS ADDRESS
ZIPCODE ZIPCODE
USERNAME PERSON
FIRSTNAME PERSON
LASTNAME PERSON
LASTNAME1 PERSON
LASTNAME2 PERSON
LASTNAME3 PERSON
FIRSTNAME1 PERSON
FIRSTNAME2 PERSON
FIRSTNAME3 PERSON
MIDDLENAME PERSON
FULLNAME PERSON
NAME PERSON
NRP NRP
EMAIL EMAIL_ADDRESS
PHONE PHONE_NUMBER
PHONENUMBER PHONE_NUMBER
TEL PHONE_NUMBER
TELEPHONE PHONE_NUMBER
MOBILE PHONE_NUMBER
BOD DATE_TIME
BIRTHDAY DATE_TIME
BIRTHDATE DATE_TIME
DOB DATE_TIME
TIME DATE_TIME
CITY LOCATION
STATE LOCATION
COUNTRY LOCATION
POSTCODE ZIPCODE
CREDITCARDNUMBER CREDIT_CARD_NUMBER
IBAN INTERNATIONAL_BANKING_ACCOUNT_NUMBER
ACCOUNTNUMBER US_BANK_ACCOUNT_NUMBER
IP IP_ADDRESS
IPV4 IP_ADDRESS
IPV6 IP_ADDRESS
SSN US_SOCIAL_SECURITY_NUMBER
SOCIALNUM US_SOCIAL_SECURITY_NUMBER
SOCIALNUMBER US_SOCIAL_SECURITY_NUMBER
SOCIAL_SECURITY US_SOCIAL_SECURITY_NUMBER
DRIVERLICENSE US_DRIVERS_LICENSE_NUMBER
PASSPORT US_PASSPORT_NUMBER
IDCARD -
SEX GENDER
GENDER -
AGE -
NAME_STUDENT PERSON
PHONE_NUM PHONE_NUMBER
ID_NUM US_SOCIAL_SECURITY_NUMBER
STREET_ADDRESS ADDRESS
URL_PERSONAL URL
KEY PASSWORD
SECRET PASSWORD
API_KEY PASSWORD
ACCOUNT_NUMBER US_BANK_ACCOUNT_NUMBER
BANK_ROUTING_NUMBER ABA_ROUTING_NUMBER
BIOMETRIC_IDENTIFIER -
BLOOD_TYPE -
BUILDING ADDRESS
CERTIFICATE_LICENSE_NUMBER MEDICAL_LICENSE
COMPANY_NAME -
COORDINATE LOCATION
COUNTY LOCATION
CREDIT_DEBIT_CARD CREDIT_CARD_NUMBER
CUSTOMER_ID -
CVV CREDIT_CARD_NUMBER
DATE_OF_BIRTH DATE_TIME
DEVICE_IDENTIFIER -
EDUCATION_LEVEL -
EMPLOYEE_ID -
EMPLOYMENT_STATUS -
FAX_NUMBER PHONE_NUMBER
FIRST_NAME PERSON
GEOCOORD LOCATION
GIVENNAME1 PERSON
GIVENNAME2 PERSON
HEALTH_PLAN_BENEFICIARY_NUMBER HEALTH_INSURANCE_ID
HTTP_COOKIE -
LANGUAGE -
LAST_NAME PERSON
LICENSE_PLATE LICENSE_PLATE_NUMBER
MAC_ADDRESS MAC_ADDRESS
MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID
NATIONAL_ID -
PASS -
PIN PASSWORD
POLITICAL_VIEW NRP
RACE_ETHNICITY RACE
RELIGIOUS_BELIEF NRP
SECADDRESS ADDRESS
SEXUALITY SEXUAL_PREFERENCE
STREET ADDRESS
SWIFT_BIC SWIFT_CODE
TAX_ID US_INDIVIDUAL_TAXPAYER_IDENTIFICATION
TITLE -
UNIQUE_ID -
UNIQUE_IDENTIFIER -
USER_NAME PERSON
VEHICLE_IDENTIFIER LICENSE_PLATE_NUMBER
US_SSN US_SOCIAL_SECURITY_NUMBER
US_PASSPORT US_PASSPORT_NUMBER
CREDIT_CARD CREDIT_CARD_NUMBER
ID_CARD -
DRIVER_LICENSE US_DRIVERS_LICENSE_NUMBER
DRIVERS_LICENSE US_DRIVERS_LICENSE_NUMBER
FULL_NAME PERSON
CONTACT_NUMBER PHONE_NUMBER
PASSPORT_NUMBER US_PASSPORT_NUMBER
GIVEN_NAME PERSON
PASSEPORT -
VILLE LOCATION
PERMIS_DE_CONDUIRE -
DATE_BG DATE_TIME
MEDICAL_RECORD_NUMBERS HEALTH_INSURANCE_ID
BUILDING_NUMBER ADDRESS
SECONDARY_ADDRESS ADDRESS
BIO_IDENTIFIER FINGERPRINT
DOCUMENT_IDENTITY -
IDENTITY_DOCUMENT -
ID_KARTE -
LICENSE_NUMBER US_DRIVERS_LICENSE_NUMBER
MEDICAL_RECORD HEALTH_INSURANCE_ID
CERTIFICATE_ID MEDICAL_LICENSE
GEOCOORDINATES LOCATION
"""

# Labels that predictions use -> canonical label.
_PREDICTED = """
US_BANK_ACCOUNT_NUMBER US_BANK_ACCOUNT_NUMBER
US_DRIVERS_LICENSE_NUMBER US_DRIVERS_LICENSE_NUMBER
US_INDIVIDUAL_TAXPAYER_IDENTIFICATION US_INDIVIDUAL_TAXPAYER_IDENTIFICATION
NRP NRP
DRIVER_LICENSE_NUMBER US_DRIVERS_LICENSE_NUMBER
US_DRIVER_LICENSE US_DRIVERS_LICENSE_NUMBER
DRIVER'S_LICENSE US_DRIVERS_LICENSE_NUMBER
SOCIAL_SECURITY_NUMBER US_SOCIAL_SECURITY_NUMBER
POSTAL_CODE ZIPCODE
US_POSTAL_CODE ZIPCODE
COUNTRY_OF_ORIGIN LOCATION
ACCOUNT_USERNAME PERSON
SIBLING_NAME PERSON
INDIVIDUAL PERSON
MRN HEALTH_INSURANCE_ID
MRN_NUMBER HEALTH_INSURANCE_ID
PATIENT_ID HEALTH_INSURANCE_ID
PATIENTID HEALTH_INSURANCE_ID
ID_CARD_NUMBER US_PASSPORT_NUMBER
BIOM_IDENTIFIER FINGERPRINT
TIME_OF_DAY DATE_TIME
SESSION_TIME DATE_TIME
"""

# The bridges between date labels, and between address labels, and the other overrides.
_DATE_BRIDGE = "DATE DATEOFBIRTH DATETIME DATE_AND_TIME TIMESTAMP"
_ADDRESS_BRIDGE = "ADDRESS STREET STREET_ADDRESS STREET_NAME BUILDING BUILDING_NUMBER SECONDARY_ADDRESS SECADDRESS"
_OVERRIDES = """
UK_NHS HEALTH_INSURANCE_ID
MEDICALRECORDNUMBER HEALTH_INSURANCE_ID
GENDER GENDER
IPV4_ADDRESS IP_ADDRESS
IPV6_ADDRESS IP_ADDRESS
ZIP_CODE ZIPCODE
ZIP ZIPCODE
POSTALCODE ZIPCODE
SOCIALSECURITYNUMBER US_SOCIAL_SECURITY_NUMBER
SOCIAL_NUMBER US_SOCIAL_SECURITY_NUMBER
PASSPORTNUMBER US_PASSPORT_NUMBER
TELEPHONE_NUMBER PHONE_NUMBER
"""

# Rules for keys in no table, in order; the first pattern found decides.
FALLBACK = [
    ("IPV?4|IPV?6|IP_?ADDR", "IP_ADDRESS", None),
    ("ZIP|POSTAL", "ZIPCODE", None),
    ("SSN|SOCIAL_SEC|SOCIALSEC", "US_SOCIAL_SECURITY_NUMBER", None),
    ("PASSPORT", "US_PASSPORT_NUMBER", None),
    ("DRIVER.*LICEN|LICEN.*DRIVER", "US_DRIVERS_LICENSE_NUMBER", None),
    ("^DATE|DATE$|BIRTH|^TIME$|TIMESTAMP", "DATE_TIME", "date"),
    ("EMAIL", "EMAIL_ADDRESS", None),
    ("PHONE|^(TEL|MOBILE|FAX)$", "PHONE_NUMBER", None),
    ("ADDRESS|^(CITY|STATE|COUNTRY|COUNTY|STREET)$", "LOCATION", "address"),
]


def _table(text: str) -> dict[str, str | None]:
    pairs = (line.split() for line in text.strip().splitlines())
    return {k: None if v == "-" else v for k, v in pairs}


BASE = _table(_BASE)
#: Later tables win over earlier ones.
BEFORE = BASE | _table(_PREDICTED)
CANON = sorted({v for v in BASE.values() if v})
#: Map variants: which bridges between labels hold.
VARIANTS = {"full": ("address", "date"), "no_address": ("date",), "no_date": ("address",), "neither": ()}


def aligned(variant: str = "full") -> dict[str, str | None]:
    """The table of a variant. Without a bridge its labels are in no table, and no rule brings them back."""
    bridges = {"address": (_ADDRESS_BRIDGE, "LOCATION"), "date": (_DATE_BRIDGE, "DATE_TIME")}
    out = BEFORE | _table(_OVERRIDES)
    for name, (keys, target) in bridges.items():
        for k in keys.split():
            out.pop(k, None)
            if name in VARIANTS[variant]:
                out[k] = target
    return out


#: What the full map has beside the base table, or in place of its entries.
LATER = {k: t for k, t in aligned().items() if k not in BASE or BASE[k] != t}


def rules(variant: str = "full") -> list[tuple[str, str]]:
    return [(p, t) for p, t, bridge in FALLBACK if bridge is None or bridge in VARIANTS[variant]]


def key(label: Column) -> Column:
    """The form under which tables hold a label; null for null."""
    return F.upper(F.translate(label, "- ", "__"))


def _strict(k: Column) -> Column:
    own = F.when(k.isin(*CANON), k)
    return F.when(F.coalesce(k, F.lit("")) == "", None).otherwise(_lookup(BASE, k, None, own))


def _lookup(table: dict, k: Column, null: str | None, absent: Column) -> Column:
    """The key's target in a folded table: `null` for a null target, absent where there is no key (or where null is None, no target)."""
    held = {name: target if target is not None else null for name, target in table.items()}
    maps = F.expr(_slots(tuple((name, target) for name, target in held.items() if target is not None)))
    return F.coalesce(F.try_element_at(F.get(maps, F.pmod(F.xxhash64(k), F.lit(SLOTS)).cast("int")), k), absent)


@cache
def _slots(items: tuple) -> str:
    """SQL of an array of maps with the items dealt by the hash of their names, as xxhash64() computes it: a lookup reads one short map."""
    lists: list[list[str]] = [[] for _ in range(SLOTS)]
    for name, target in items:
        lists[xxhash.xxh64_intdigest(name.encode(), 42) % SLOTS] += ["'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in (name, target)]
    return "array(" + ", ".join(f"map({', '.join(own)})" if own else "cast(map() as map<string, string>)" for own in lists) + ")"


def _lenient(k: Column, table: dict) -> Column:
    return F.when(F.coalesce(k, F.lit("")) == "", UNKNOWN).otherwise(_lookup(table, k, UNKNOWN, k))


def _symmetric(k: Column, variant: str) -> Column:
    rest = None
    for pattern, target in rules(variant):
        rest = F.when(k.rlike(pattern), target) if rest is None else rest.when(k.rlike(pattern), target)
    return F.when(F.coalesce(k, F.lit("")) == "", UNKNOWN).otherwise(_lookup(aligned(variant), k, UNKNOWN, rest.otherwise(k)))


def strict(label: Column) -> Column:
    """Target of the base table; else the key if it is a canonical label; else null."""
    return _strict(key(label))


def lenient(label: Column, table: dict | None = None) -> Column:
    """Target of the table, UNKNOWN for a null target or an empty label, the key itself where it is absent."""
    return _lenient(key(label), BEFORE if table is None else table)


def symmetric(label: Column, variant: str = "full") -> Column:
    """Table of the variant, then the rules in order, then the key itself."""
    return _symmetric(key(label), variant)


def by_key(k: Column, how: str) -> Column:
    """Canonical label of a key, by name: "before", "strict", "raw" or a variant of the aligned map."""
    if how in VARIANTS:
        return _symmetric(k, how)
    return {"before": lambda: _lenient(k, BEFORE), "strict": lambda: _strict(k), "raw": lambda: k}[how]()


def mapped(label: Column, how: str) -> Column:
    return by_key(key(label), how)
