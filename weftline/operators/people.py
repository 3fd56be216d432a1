"""People: records drawn from small pools, rows of a managed dataset, and fields derived from them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.draws import Conditional, bound, rank_key
from weftline.operators.samplers import Draw, pick
from weftline.sources.seeds import indexed, ranked

AGES = (18, 114)
# Small pools in place of a names library.
FIRST = {"Female": ["Ada", "Beth", "Carla", "Dana", "Elena", "Fay", "Grace", "Hana", "Ines", "Jade", "Kira", "Lena"], "Male": ["Alan", "Bruno", "Carl", "Dario", "Emil", "Felix", "Glen", "Hugo", "Ivan", "Jon", "Karl", "Leo"]}
LAST = ["Abel", "Brook", "Cole", "Dale", "Ellis", "Ford", "Grant", "Hale", "Irwin", "Jones", "Kent", "Lowe", "Moss", "Nash", "Olsen", "Price"]
#: Cities with a post code, its telephone area and people in thousands; public facts, rounded.
PLACES = [
    ("Boston", "MA", "02108", "617", 650), ("Cambridge", "MA", "02139", "617", 118), ("Hartford", "CT", "06103", "860", 120), ("New York", "NY", "10001", "212", 1600),
    ("New York", "NY", "10451", "718", 1400), ("Brooklyn", "NY", "11201", "718", 2600), ("Albany", "NY", "12207", "518", 100), ("Buffalo", "NY", "14202", "716", 275),
    ("Philadelphia", "PA", "19103", "215", 1580), ("Dover", "DE", "19901", "302", 38), ("Washington", "DC", "20001", "202", 680), ("Atlanta", "GA", "30303", "404", 500),
    ("Miami", "FL", "33130", "305", 440), ("Detroit", "MI", "48226", "313", 630), ("Minneapolis", "MN", "55401", "612", 425), ("Helena", "MT", "59601", "406", 33),
    ("Chicago", "IL", "60601", "312", 900), ("Chicago", "IL", "60614", "773", 1800), ("Springfield", "IL", "62701", "217", 114), ("Dallas", "TX", "75201", "214", 1300),
    ("Houston", "TX", "77002", "713", 2300), ("Austin", "TX", "78701", "512", 960), ("Denver", "CO", "80202", "303", 715), ("Boulder", "CO", "80302", "303", 108),
    ("Boise", "ID", "83702", "208", 235), ("Phoenix", "AZ", "85004", "602", 1600), ("Los Angeles", "CA", "90012", "213", 2000), ("Beverly Hills", "CA", "90210", "310", 33),
    ("San Francisco", "CA", "94103", "415", 870), ("Honolulu", "HI", "96813", "808", 350), ("Portland", "OR", "97201", "503", 650), ("Salem", "OR", "97301", "503", 175), ("Seattle", "WA", "98101", "206", 740),
]
#: First and last area number of the national ids of each state, as the Social Security Administration allotted them until 2011. Fixed values.
STATE_AREAS = {
    "NH": (1, 3), "ME": (4, 7), "VT": (8, 9), "MA": (10, 34), "RI": (35, 39), "CT": (40, 49), "NY": (50, 134), "NJ": (135, 158), "PA": (159, 211), "MD": (212, 220),
    "DE": (221, 222), "VA": (223, 231), "WV": (232, 236), "NC": (237, 246), "SC": (247, 251), "GA": (252, 260), "FL": (261, 267), "OH": (268, 302), "IN": (303, 317), "IL": (318, 361),
    "MI": (362, 386), "WI": (387, 399), "KY": (400, 407), "TN": (408, 415), "AL": (416, 424), "MS": (425, 428), "AR": (429, 432), "LA": (433, 439), "OK": (440, 448), "TX": (449, 467),
    "MN": (468, 477), "IA": (478, 485), "MO": (486, 500), "ND": (501, 502), "SD": (503, 504), "NE": (505, 508), "KS": (509, 515), "MT": (516, 517), "ID": (518, 519), "WY": (520, 520),
    "CO": (521, 524), "NM": (525, 525), "AZ": (526, 527), "UT": (528, 529), "NV": (530, 530), "WA": (531, 539), "OR": (540, 544), "CA": (545, 573), "AK": (574, 574), "HI": (575, 576), "DC": (577, 579),
}
#: The day from which area numbers no longer went by state.
RANDOM_SINCE = "2011-06-25"
ANY_AREA = (1, 899)
STREETS = ["Oak Street", "Mill Road", "Park Avenue", "Lake Drive", "Hill Lane", "Church Street"]
MARITAL = ["single", "engaged", "married", "in partnership", "no longer married"]
EDUCATION = {"primary school": 1, "lower secondary school": 2, "upper secondary school": 4, "vocational training": 3, "university": 3, "doctorate": 1}
#: The ten broad fields of education of the public classification ISCED-F 2013 (UNESCO), which is cited here by name.
FIELDS = ["generic programmes", "education", "arts and humanities", "social sciences", "business and law", "natural sciences", "information technologies", "engineering and construction", "agriculture", "health and welfare"]
STUDIED = ("university", "doctorate")
JOBS = ["teacher", "nurse", "engineer", "clerk", "driver", "cook", "manager", "farmer"]
#: Providers of mail by the age from which a band begins, with weights of this repository's own.
DOMAINS = {
    "0": {"gmail.com": 62.0, "icloud.com": 25.0, "outlook.com": 5.0, "hotmail.com": 3.0, "yahoo.com": 3.0, "protonmail.com": 2.0},
    "30": {"gmail.com": 45.0, "icloud.com": 30.0, "outlook.com": 8.0, "hotmail.com": 6.0, "yahoo.com": 8.0, "protonmail.com": 3.0},
    "50": {"gmail.com": 40.0, "icloud.com": 25.0, "outlook.com": 9.0, "hotmail.com": 11.0, "yahoo.com": 13.0, "aol.com": 2.0},
}
#: Kinds of user names and of what follows them, with weights of this repository's own; those with a middle name come last.
NAMES = {"first.last": 30.0, "firstlast": 20.0, "flast": 15.0, "first_last": 10.0, "lastf": 15.0, "firstl": 10.0}
MIDDLE_NAMES = {"firstmiddle": 8.0, "firstmlast": 8.0, "firstmiddlelast": 8.0}
ENDINGS = {"none": 40.0, "number": 30.0, "short year": 10.0, "year": 10.0, "day": 10.0}
NEAR = {"postcode": 60.0, "four": 20.0, "three": 10.0, "anywhere": 10.0}
STYLES = ("dash", "parentheses", "dot", "space", "no_separation", "international_plus", "international")


def areas_by_postcode(places: list[tuple] = PLACES) -> Conditional:
    """Telephone areas by people, for each post code and its first four and three digits, and for all ('')."""
    groups: dict[str, dict[str, float]] = {}
    for _, _, code, area, people in places:
        for digits in (5, 4, 3, 0):
            of = groups.setdefault(code[:digits], {})
            of[area] = of.get(area, 0.0) + people
    return Conditional(groups)


AREAS = areas_by_postcode()
DOMAIN_OF, NAME_OF, ENDING_OF, NEAR_OF = Conditional(DOMAINS), Conditional({"two": NAMES, "three": NAMES | MIDDLE_NAMES}), Conditional({"": ENDINGS}), Conditional({"": NEAR})


def birth_date(age: Column, u: Column, today: str) -> Column:
    """A random day in the year that gives the age on ``today``."""
    end = F.add_months(F.lit(today).cast("date"), -12 * age)
    start = F.date_add(F.add_months(end, -12), 1)
    return F.date_add(start, F.floor(u * (F.datediff(end, start) + 1)).cast("int"))


def plain_name(c: Column) -> Column:
    """Small letters and digits, with the common accents taken off."""
    return F.regexp_replace(F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"), "[^a-z0-9]", "")


def email(first: Column, last: Column, age: Column, born: Column, d: Draw, middle: Column | None = None) -> Column:
    """None below 18. The provider goes by age, the user name by one of six patterns, nine with a middle name, and what follows it is
    nothing, a number, the year of birth, its last digits or the day."""
    f, l, m = plain_name(first), plain_name(last), plain_name(middle) if middle is not None else F.lit(None).cast("string")  # noqa: E741
    one = lambda c: F.left(c, F.lit(1))
    names = {"first.last": (f, F.lit("."), l), "firstlast": (f, l), "flast": (one(f), l), "first_last": (f, F.lit("_"), l), "lastf": (l, one(f)), "firstl": (f, one(l)), "firstmiddle": (f, m), "firstmlast": (f, one(m), l), "firstmiddlelast": (f, m, l)}
    endings = {"number": (F.lit(1) + F.floor(d.u("mail number") * 99)).cast("string"), "short year": F.date_format(born, "yy"), "year": F.date_format(born, "yyyy"), "day": F.dayofmonth(born).cast("string")}

    def chosen(kind: Column, of: dict[str, Column]) -> Column:
        return bound(kind, lambda k: F.coalesce(*(F.when(k == name, x) for name, x in of.items()), F.lit("")))

    name = chosen(NAME_OF.column(F.when(F.length(m) > 0, "three").otherwise("two"), d.u("mail name")), {k: F.concat(*x) for k, x in names.items()})
    ending = chosen(ENDING_OF.column(F.lit(""), d.u("mail end")), endings)
    band = F.when(age < 30, "0").when(age < 50, "30").otherwise("50")
    return F.when(age >= 18, F.concat(name, ending, F.lit("@"), DOMAIN_OF.column(band, d.u("mail domain"))))


def phone(age: Column, postcode: Column, d: Draw, style: str = "dash", areas: Conditional = AREAS) -> Column:
    """None below 18 or without a post code. The area is that of the post code in six of ten cases, of one that shares its first four
    digits in two, its first three in one, or any, by people. A code that the table lacks stands for its nearest that it has."""
    if style not in STYLES:
        raise ValueError(f"no style is named {style!r}")
    how, u = NEAR_OF.column(F.lit(""), d.u("phone near")), d.u("phone area")
    known = list(areas.groups)
    near = bound(how, lambda h: F.when(h == "postcode", postcode).when(h == "four", F.left(postcode, F.lit(4))).when(h == "three", F.left(postcode, F.lit(3))).otherwise(""))
    key = bound(near, lambda x: F.when(x.isin(known), x).when(F.left(x, F.lit(4)).isin(known), F.left(x, F.lit(4))).when(F.left(x, F.lit(3)).isin(known), F.left(x, F.lit(3))).otherwise(""))
    area = areas.column(key, u)
    office, line = (F.lit(200) + F.floor(d.u("phone office") * 800)).cast("string"), F.lpad(F.floor(d.u("phone line") * 10_000).cast("string"), 4, "0")
    form = {"dash": "{}-{}-{}", "parentheses": "({}) {}-{}", "dot": "{}.{}.{}", "space": "{} {} {}", "no_separation": "{}{}{}", "international_plus": "+1 {} {} {}", "international": "001 {} {} {}"}[style]
    return F.when((age >= 18) & postcode.isNotNull(), F.format_string(form.replace("{}", "%s"), area, office, line))


def national_id(state: Column, born: Column, d: Draw) -> Column:
    """Three parts. The first lies in the state's range for those born before such ranges were given up, else anywhere; 666 doesn't
    occur. None without a state."""
    ranges = F.create_map(*(x for k, v in STATE_AREAS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    anywhere = F.array(*map(F.lit, ANY_AREA))
    of = F.when(born < F.lit(RANDOM_SINCE).cast("date"), F.coalesce(F.try_element_at(ranges, state), anywhere)).otherwise(anywhere)

    def drawn(r: Column) -> Column:
        low, high = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        holds = ((low <= 666) & (high >= 666)).cast("int")  # one number fewer, and those from 666 on move up
        area = low + F.floor(d.u("id area") * (high - low + 1 - holds)).cast("int")
        return F.when((holds == 1) & (area >= 666), area + 1).otherwise(area)

    part = lambda name, most: (F.lit(1) + F.floor(d.u(name) * most)).cast("int")
    return F.when(state.isNotNull(), F.format_string("%03d-%02d-%04d", bound(of, drawn), part("id group", 99), part("id serial", 9999)))


def derived(person: Column, names: list[str], d: Draw, today: str = "2025-01-01") -> Column:
    """A managed person with what is derived from its fields, where the dataset doesn't tell it: birth date, email, phone, national id."""
    at = lambda c: person[c] if c in names else F.lit(None).cast("string")
    if not {"first_name", "last_name", "age"} <= set(names):
        return person
    born = F.to_date(person["birth_date"]) if "birth_date" in names else birth_date(person["age"].cast("int"), d.u("birth"), today)
    more = {"birth_date": F.date_format(born, "yyyy-MM-dd"), "email_address": email(person["first_name"], person["last_name"], person["age"], born, d, at("middle_name")), "phone_number": phone(person["age"], at("postcode"), d), "national_id": national_id(at("state"), born, d)}
    return F.struct(*(person[n].alias(n) for n in names), *(c.alias(n) for n, c in more.items() if n not in names))


def person(params: dict[str, Any], d: Draw, today: str = "2025-01-01") -> Column:
    """A struct of one person's fields. ``sex``, ``city`` and ``age_range`` narrow it."""
    low, high = params.get("age_range") or AGES
    age = F.lit(int(low)) + F.floor(d.u("age") * (int(high) - int(low) + 1)).cast("int")
    sex = F.lit(params["sex"]) if params.get("sex") else F.when(d.u("sex") < 0.5, "Female").otherwise("Male")
    first = F.when(sex == "Female", pick(d.u("first"), FIRST["Female"], None)).otherwise(pick(d.u("first"), FIRST["Male"], None))
    last = pick(d.u("last"), LAST, None)
    cities = params.get("city")
    cities = [cities] if isinstance(cities, str) else cities
    places = [p[:3] for p in PLACES if not cities or p[0] in cities] or [(c, "NA", "00000") for c in cities or []]
    place = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(p, ("city", "state", "postcode"), strict=True))) for p in places)), F.floor(d.u("place") * len(places)).cast("int") + 1)
    born = birth_date(age, d.u("birth"), today)
    education = pick(d.u("education"), list(EDUCATION), list(EDUCATION.values()))
    return F.struct(
        F.md5(F.concat_ws("|", F.lit(f"{d.seed}|{d.column}|person"), d.row.cast("string"))).alias("uuid"),
        F.lit(params.get("locale", "en_US")).alias("locale"),
        first.alias("first_name"),
        last.alias("last_name"),
        sex.alias("sex"),
        (F.lit(1) + F.floor(d.u("number") * 999)).cast("string").alias("street_number"),
        pick(d.u("street"), STREETS, None).alias("street_name"),
        place["city"].alias("city"),
        place["state"].alias("state"),
        place["postcode"].alias("postcode"),
        age.alias("age"),
        F.date_format(born, "yyyy-MM-dd").alias("birth_date"),
        F.lit("USA").alias("country"),
        pick(d.u("marital"), MARITAL, None).alias("marital_status"),
        education.alias("education_level"),
        F.when(education.isin(*STUDIED), pick(d.u("field"), FIELDS, None)).otherwise("none").alias("bachelors_field"),
        pick(d.u("job"), JOBS, None).alias("occupation"),
        email(first, last, age, born, d).alias("email_address"),
        phone(age, place["postcode"], d, params.get("phone_style", "dash")).alias("phone_number"),
        national_id(place["state"], born, d).alias("national_id"),
    )


#: Columns of managed people datasets that are taken over, by what they tell. Names of the datasets' columns.
PERSON_FIELDS = (
    "uuid", "first_name", "middle_name", "last_name", "sex", "age", "marital_status", "postcode", "city", "district", "region", "country", "street_name", "street_number",
    "unit", "bachelors_field", "education_level", "occupation", "locale", "birth_date", "state", "email_address", "phone_number", "national_id",
    "ethnic_background", "industry", "preferred_english_name", "first_name_heritage", "name_heritage", "is_first_gen_immigrant", "household_type",
    "monthly_income_eur", "area", "blood_pressure_status", "blood_sugar_status", "bmi_status", "drinking_status", "economic_activity_status",
    "family_type", "housing_tenure", "housing_type", "income_bracket", "military_status", "smoking_status", "waist_status", "race", "education_degree",
    "first_language", "second_language", "third_language", "zone", "religion",
)
#: The same of personas. Fixed values.
PERSONA_FIELDS = (
    "persona", "detailed_persona", "professional_persona", "career_goals_and_ambitions", "cultural_background", "arts_persona", "culinary_persona",
    "finance_persona", "healthcare_persona", "sports_persona", "travel_persona", "hobbies_and_interests", "hobbies_and_interests_list",
    "skills_and_expertise", "skills_and_expertise_list", "openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism", "aspects",
    "digital_skill", "family_persona", "religious_persona", "religious_background", "linguistic_persona", "linguistic_background",
)


def projected(people: DataFrame, personas: bool = False, locale: str = "en_US") -> DataFrame:
    """The known fields of people, and those of personas where asked for, with the locale; fields without any value are left
    out, which one pass tells."""
    people = people.withColumn("locale", F.lit(locale))
    names = [c for c in (*PERSON_FIELDS, *(PERSONA_FIELDS if personas else ())) if c in people.columns]
    some = people.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in names)).first()
    return people.select(*(c for c in names if some[c]))


def sample_people(people: DataFrame, rows: DataFrame, params: dict[str, Any], seed: int, name: str, key: str, row: str = "_row_id", count: int | None = None) -> DataFrame:
    """Rows of a managed dataset, without repeats: those that fit, in a random order by hash, joined by place.

    ``sex``, ``city``, ``age_range`` and the lists of ``select_field_values`` narrow the people. Fewer people than rows is an
    error. Where ``count`` is given, ``row`` counts from 0 and is below it, so rows are their own places; else they are
    numbered by parts. The order is told within buckets of the hash, so no task sorts all people.
    """
    fits = people
    wanted = {c: params[c] for c in ("sex", "city") if params.get(c)} | (params.get("select_field_values") or {})
    for column, values in wanted.items():
        column = "region" if column == "state" and "state" not in fits.columns else column
        if column not in fits.columns:
            raise ValueError(f"people have no field {column!r}")
        fits = fits.where(F.col(column).isin(values if isinstance(values, list) else [values]))
    low, high = params.get("age_range") or AGES
    fits = fits.where(F.col("age").between(int(low), int(high)))
    if params.get("locale", "en_US") == "en_US" and "region" in fits.columns and "state" not in fits.columns:
        fits = fits.withColumnRenamed("region", "state")
    if (have := fits.count()) < (want := rows.count() if count is None else count):
        raise ValueError(f"{want} people are asked for, and {have} fit")
    held = ranked(fits, rank_key(seed, name, F.col(key)), key, have, [], "_place").where(F.col("_place") < want)
    placed = indexed(rows, [row], "_place") if count is None else rows.withColumn("_place", F.col(row))
    columns = [c for c in held.columns if c not in ("_place", "_person")]
    return placed.join(held.select("_place", F.struct(*columns).alias(name)), "_place").drop("_place")
