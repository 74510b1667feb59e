"""Contextual patterns for persons, places and organisations.

Fixed values: patterns, confidences and name lists. Gates are ours.
"""

from veilframe.rules.model import EDGE, Rule

KNOWN_PERSONS = (
    r"Rajesh\s+Kumar|Sundar\s+Pichai|Satya\s+Nadella|Alice\s+Johnson|Bob\s+Smith|"
    r"Rahul\s+Sharma|Vikram\s+Malhotra|John\s+Doe|Jane\s+Smith|Priya\s+Patel|Amit\s+Shah|"
    r"Ananya\s+Deshmukh|Rohan\s+Gupta|Michael\s+Scott|Sarah\s+Connor|Bruce\s+Wayne|"
    r"Clark\s+Kent|Tony\s+Stark|Steve\s+Rogers")
KNOWN_CITIES = (
    r"Mumbai|Bangalore|Bengaluru|New\s+Delhi|Delhi|Pune|Hyderabad|Chennai|Kolkata|Ahmedabad|"
    r"Jaipur|Surat|Lucknow|San\s+Francisco|New\s+York|Los\s+Angeles|Chicago|Seattle|Austin|"
    r"London|Paris|Berlin|Tokyo|Singapore|Dubai|Sydney|Toronto")
KNOWN_REGIONS = (
    r"Maharashtra|Karnataka|Tamil\s+Nadu|Gujarat|Rajasthan|Uttar\s+Pradesh|Kerala|"
    r"Delhi\s+NCR|California|Texas|New\s+York|Washington|Florida|India|United\s+States|USA|"
    r"United\s+Kingdom|UK|Germany|France|Japan|Australia|Canada|UAE")
ADDRESS_ENDS = (
    r"Mumbai|Bangalore|Delhi|Pune|Hyderabad|Chennai|Kolkata|London|New York|San Francisco|"
    r"Berlin|Tokyo|India|USA|UK|California|Maharashtra|Karnataka|Texas|Dubai")
KNOWN_COMPANIES = (
    r"Zerops|Zerops\s+AG|Google|Google\s+LLC|Microsoft|Microsoft\s+Corp|Apple|Apple\s+Inc|"
    r"Amazon|Amazon\s+AWS|Meta|Meta\s+Platforms|OpenAI|Anthropic|GitHub|Slack|Stripe|Twilio|"
    r"SendGrid|Cloudflare|HDFC\s+Bank|ICICI\s+Bank|State\s+Bank\s+of\s+India|SBI|"
    r"Axis\s+Bank|JPMorgan\s+Chase|Goldman\s+Sachs|Tata\s+Consultancy\s+Services|TCS|Infosys|"
    r"Wipro|Reliance\s+Industries")
COMPANY_ENDS = (
    r"Inc\.|LLC|Corp\.|Corporation|Ltd\.|Limited|Pvt\s+Ltd|GmbH|AG|SA|Holdings|Technologies|"
    r"Enterprises|Solutions")


# A run of capitalised words up to its last company end is the span; a run without one is passed
# over as a whole, so that no place in it is tried again. Possessive groups run as loops.
_ITEM, _END = r"[A-Z][A-Za-z0-9]++", f"(?:{COMPANY_ENDS}){EDGE}"
_NAME_RUN = (rf"(?<!\w)(?:({_ITEM}(?:(?:\s++(?!{_END}){_ITEM})*+\s++{_END})++)"
             rf"|{_ITEM}(?:\s++{_ITEM})*+)")


def _words(alternatives: str) -> tuple[str, ...]:
    """First word of every alternative: a literal that must occur."""
    return tuple(dict.fromkeys(a.split(r"\s+")[0] for a in alternatives.split("|")))


def entity_rules(strict_case: bool = False):
    """Three person, four place and three organisation patterns.

    The organisation anchor is case-insensitive, so its capital-letter class also takes
    lower case and it over-captures; ``strict_case`` keeps the class to capitals.
    """
    org_class = r"((?-i:[A-Z])" if strict_case else r"([A-Z]"
    return (
        Rule("PER_ANCHOR",
             r"(?:(?:name|cardholder\s*name|candidate|employee|patient|customer|user|"
             r"full\s*name|resident|holder|officer)\s*[:=\-]?\s*)"
             r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})",
             type="PER", label="PERSON", confidence=99.2, group=1,
             any_literal=("name", "candidate", "employee", "patient", "customer", "user",
                          "resident", "holder", "officer"),
             gate=r"[A-Z][a-z]+\s+[A-Z][a-z]"),
        Rule("PER_KNOWN", f"(?:{KNOWN_PERSONS})", "word", "word", type="PER", label="PERSON",
             confidence=99.2, words=_words(KNOWN_PERSONS)),
        Rule("PER_TITLE", r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
             "word", "word", type="PER", label="PERSON", confidence=99.2, group=1,
             words=("Mr", "Mrs", "Ms", "Dr", "Prof"),
             jvm=r"(?<!\w)(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s++([A-Z][a-z]++(?:\s++[A-Z][a-z]++(?!\w))++)"),
        Rule("LOC_STREET",
             r"\d{1,5}\s+(?:[A-Z][a-z]+\s+)?(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|"
             r"Ln|Drive|Dr|Way|Marg|Nagar|Colony|Sector\s+\d+)",
             "word", "word", type="LOC", label="LOCATION", confidence=98.8,
             words=("Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Blvd", "Lane",
                    "Ln", "Drive", "Dr", "Way", "Marg", "Nagar", "Colony", "Sector"),
             gate=r"\d\s+[A-Z]"),
        Rule("LOC_ANCHOR",
             r"(?i)(?:(?:address|location|city|residence|destination|origin|state|country|"
             r"office\s*at)\s*[:=\-]?\s*)"
             rf"([0-9A-Za-z\s,.\-#]{{5,80}}(?:{ADDRESS_ENDS}))",
             type="LOC", label="LOCATION", confidence=98.8, group=1,
             any_literal=("address", "location", "city", "residence", "destination", "origin",
                          "state", "country", "office"), fold_case=True,
             gate=f"(?i)(?:{ADDRESS_ENDS})"),
        Rule("LOC_CITY", f"(?:{KNOWN_CITIES})", "word", "word", type="LOC", label="LOCATION",
             confidence=98.8, words=_words(KNOWN_CITIES)),
        Rule("LOC_REGION", f"(?:{KNOWN_REGIONS})", "word", "word", type="LOC", label="LOCATION",
             confidence=98.8, words=_words(KNOWN_REGIONS)),
        Rule("ORG_KNOWN", f"(?:{KNOWN_COMPANIES})", "word", "word", type="ORG",
             label="ORGANIZATION", confidence=99.4, words=_words(KNOWN_COMPANIES)),
        Rule("ORG_ANCHOR",
             r"(?i)(?:(?:company|organization|org|employer|vendor|client|bank|firm|agency|"
             r"institution|provider)\s*[:=\-]?\s*)"
             + org_class + r"[A-Za-z0-9\s&.\-]{2,40}"
             r"(?:Inc\.|LLC|Corp\.|Ltd\.|GmbH|AG|Group|Technologies|Bank|Services|Pvt\s*Ltd)?)",
             type="ORG", label="ORGANIZATION", confidence=99.4, group=1,
             any_literal=("company", "org", "employer", "vendor", "client", "bank",
                          "firm", "agency", "institution", "provider"), fold_case=True),
        Rule("ORG_SUFFIX",
             r"[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\s+" + f"(?:{COMPANY_ENDS})",
             "word", "edge", type="ORG", label="ORGANIZATION", confidence=99.4,
             words=("Inc", "LLC", "Corp", "Corporation", "Ltd", "Limited", "Pvt", "GmbH", "AG",
                    "SA", "Holdings", "Technologies", "Enterprises", "Solutions"),
             jvm=_NAME_RUN, jvm_group=1),
    )


ENTITY_RULES = entity_rules()
