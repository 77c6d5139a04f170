"""What single rows and sections of a specification table say, as column expressions; null where they say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, in any case."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def says(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")


def told(text: Column, *ladder: tuple[str, object]) -> Column:
    """The value beside the first pattern that the text matches."""
    out = F.lit(None)
    for pattern, value in reversed(ladder):
        out = F.when(says(text, pattern), F.lit(value)).otherwise(out)
    return out


def number(text: Column, pattern: str, low: float, high: float, kind: str = "int") -> Column:
    v = found(text, pattern).try_cast(kind)
    return F.when(v.between(low, high), v)


def denied(text: Column) -> Column:
    return says(text, r"\b(?:no|none|n/a|false|without|not)\b")


def tidy(text: Column) -> Column:
    """Trade marks and marks of direction gone, white space single; null if nothing or only a denial is left."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, "[®™©‎‏​ ]", " "), r"\s+", " "))
    return F.when((t != "") & ~says(t, r"^(?:none|n/a|no)$"), t)


# Identity

#: Brands by their word.
BRANDS = {"asus": "ASUS", "acer": "Acer", "dell": "Dell", "hp": "HP", "lenovo": "Lenovo", "msi": "MSI", "gigabyte": "Gigabyte", "apple": "Apple", "razer": "Razer", "samsung": "Samsung", "huawei": "Huawei", "microsoft": "Microsoft"}


def brand(text: Column) -> Column:
    return told(text, *[(rf"\b{word}\b", name) for word, name in BRANDS.items()], (r"\brog\b", "ASUS"))


#: Forms of makers' part numbers: 9S7-.., 90N..., NX....., 8xxx (ten signs), 1234567#ABC, XX123YY-....
PART_FORMS = [r"9S7-[A-Z0-9]+-[A-Z0-9]+", r"90N[A-Z0-9]{5}-[A-Z0-9]+", r"NX\.[A-Z0-9]{5}\.[A-Z0-9]{3}", r"8[0-3][A-Z0-9]{8}", r"[A-Z0-9]{7}#[A-Z0-9]{3}", r"[A-Z]{2}\d{3}[A-Z]{2,4}-[A-Z0-9]+"]


def part_form(text: Column) -> Column:
    """A text that is, as a whole, a maker's part number."""
    return found(F.trim(text), f"^({'|'.join(PART_FORMS)})$")


def part_in_title(text: Column) -> Column:
    """The first token of a title that looks like a part number: joined by - . or #, or two digits and six to eight signs, and no word of a specification."""
    tokens = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z0-9]+(?:[-.#][A-Za-z0-9]+)+|[0-9]{2}[A-Za-z0-9]{6,8})\b"))
    fine = lambda t: (F.length(t) >= 6) & ~t.rlike(r"(?i)^(?:2-in-1|wi-fi|win-11|type-c)$|^(?:i[3579]|r[3579]|core|ryzen|ultra)[-_]\w|rtx|gtx|ddr|ssd|hdd|ips|fhd|qhd|wuxga|oled|^\d+\.\d+$")
    return F.get(F.filter(tokens, fine), F.lit(0))


def listing_name(title: Column) -> Column:
    """A title up to where its specifications begin."""
    t = F.regexp_replace(F.trim(title), r"(?i)^(?:laptop|notebook)\s+", "")
    head = F.trim(F.split(t, r"\s+[–—|]\s+|\s+-\s+(?=(?:Intel|AMD|Ryzen|Core|Snapdragon|Apple|\d+GB|RTX))|,\s+(?=(?:Intel|AMD|Ryzen|Core|Snapdragon|\d+GB|RTX))", 2)[0])
    named, cut = found(head, r"^(.*?\b(?:gaming\s+laptop|laptop|notebook)\b)"), F.rtrim(found(head, r"^(.*?)\b(?:Intel|AMD|Ryzen|Core\s+[i\d]|Core\s+Ultra|\d+GB\s+(?:RAM|DDR)|RTX|GeForce)\b"))
    return F.when(F.length(named) > 8, named).when(F.length(cut) > 5, F.regexp_replace(cut, r"[ ,–-]+$", "")).otherwise(head)


#: Product families.
FAMILIES = [
    "Omen Transcend", "Pavilion Plus", "Pavilion Aero", "Envy x360", "Spectre x360", "Legion Pro", "Legion Slim", "LOQ Essential", "IdeaPad Pro", "IdeaPad Slim", "IdeaPad Gaming", "IdeaPad Flex", "Victus", "Omen", "Pavilion", "Envy", "Spectre", "ProBook", "EliteBook", "ZBook", "Legion", "LOQ", "IdeaPad", "ThinkPad", "ThinkBook", "Yoga",
    "ROG Strix", "ROG Zephyrus", "ROG Flow", "TUF Gaming", "TUF", "Vivobook", "Zenbook", "ExpertBook", "Nitro", "Predator", "Aspire", "Swift", "TravelMate", "Inspiron", "Latitude", "Vostro", "Precision", "XPS", "Alienware", "Katana", "Cyborg", "Raider", "Stealth", "Thin", "Modern", "Prestige", "MacBook Air", "MacBook Pro", "Galaxy Book", "MateBook", "Surface Laptop", "Surface Pro", "Blade", "Aero", "Aorus",
]


def family(text: Column, families: list[str]) -> Column:
    """The longest family named."""
    return told(text, *[(rf"\b{f}\b", f) for f in sorted(families, key=lambda f: (-len(f), f))])


def bundle(title: Column) -> Column:
    return says(title, r"\b(?:bundle|carrying\s+case|backpack)\b|\bmouse\s*[+&]\s*bag\b|\bwith\s+(?:mouse|bag|backpack)\b")


def colour(text: Column) -> Column:
    """A colour's name: brackets, words about gamuts and panels, and repeats cut."""
    t = F.regexp_replace(text, r"\(.*?\)", "")
    t = F.split(t, r"(?i)\b(?:coverage|gamut|accuracy|\d+%\s*(?:srgb|ntsc|dci-p3)|oled|fhd|qhd|\d{3}hz|\d{3}-nit|brightness|displayhdr|dolby vision|x-rite|pantone)\b", 2)[0]
    t = F.regexp_replace(t, r"^[ ,\-|/]+|[ ,\-|/]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^(.+?)\s+\1$", "$1"), r"(?i)\b(\w+)\s+\1\b", "$1")
    return tidy(t)


def colour_in_title(title: Column) -> Column:
    t = F.regexp_replace(title, r"(?i)\b(?:white|blue|rgb|single\s+color)\s+backlit(?:\s+keyboard)?\b", "")
    return F.initcap(found(t, r"\b((?:(?:shadow|luna|eclipse|mica|abyssal|mecha|storm|cosmos|jade|cool|platinum|pure|basalt|glacier|phantom|natural|jet|carbon)\s+)?(?:black|grey|gray|silver|blue|white|gold)|graphite|platinum)\b"))


def warranty_years(text: Column) -> Column:
    return F.coalesce(number(text, r"\b([1-5])\s*[-–]?\s*(?:years?|yr|y)\b", 1, 5), F.floor(number(text, r"\b(12|24|36|48)\s*months?\b", 12, 48) / 12).cast("int"))


def condition(text: Column) -> Column:
    return told(text, ("refurbished", "Refurbished"), ("used", "Used"), ("open box", "Open Box"), ("new", "New"))


# Silicon

def npu_tops(text: Column) -> Column:
    return number(text, r"\b(\d+(?:\.\d+)?)\s*(?:ai\s*)?tops\b", 1, 200, "double")


def base_power(text: Column) -> Column:
    return number(text, r"\b(\d{2,3})\s*w\s*(?:tdp|(?:processor\s*)?base\s*power)\b", 10, 999)


def boost_mhz(text: Column) -> Column:
    return number(text, r"\b([12]\d{3})\s*mhz\b", 1000, 2999)


def gpu_tops(text: Column) -> Column:
    return number(text, r"\b(\d{2,4})\s*(?:ai\s*)?tops\b", 50, 9999)


def gpu_watts(text: Column) -> Column:
    """Watts, but for those that dynamic boost adds."""
    return number(F.regexp_replace(text, r"(?i)\+\s*\d{2,3}\s*w\b|\b\d{2,3}\s*w\s*dynamic\s*boost", " "), r"\b(\d{2,3})\s*w\b", 10, 250)


def graphics(text: Column) -> Column:
    """The chip's full name: RTX, GTX, MX, RX and Arc in this order, then integrated ones."""
    number_of = lambda pattern: F.upper(F.regexp_replace(found(text, pattern), r"\s+", " "))
    named = [(r"\brtx\s*([2-5]\d{3}(?:\s*(?:ti|super))?)\b", "GeForce RTX "), (r"\bgtx\s*((?:16[56]0|10[5-8]0)(?:\s*ti)?)\b", "GeForce GTX "), (r"\bmx\s*([1-5]\d{2})\b", "GeForce MX"), (r"\bradeon\s*(?:rx\s*)?([67]\d{3}[ms](?:\s*xt)?)\b", "Radeon RX "), (r"\barc\s+(a\d{3}m)\b", "Intel Arc ")]
    return F.coalesce(*[F.concat(F.lit(head), number_of(pattern)) for pattern, head in named], told(text, (r"\biris\s*xe\b", "Intel Iris Xe"), (r"\bintel\s+uhd\b", "Intel UHD Graphics"), (r"\bintel\s+arc\b", "Intel Arc Graphics"), (r"\bradeon\s+graphics\b", "Radeon Graphics"), (r"\badreno\b", "Adreno"), (r"\bintegrated\b", "Integrated")))


def graphics_maker(model: Column) -> Column:
    return told(model, ("geforce", "NVIDIA"), ("radeon", "AMD"), ("intel", "Intel"), ("adreno", "Qualcomm"))


def graphics_built_in(model: Column) -> Column:
    return F.when(model.isNotNull(), ~says(model, r"geforce|radeon rx|arc a\d"))


# Memory and storage

def memory_gb(text: Column) -> Column:
    """Sizes of a soldered and a plugged part together."""
    part = lambda k: found(text, r"(\d+)\s*GB\s*(?:(?:LP)?DDR[345]x?\s*)?(?:soldered|on-?\s*board)[^+\n]*\+\s*(\d+)\s*GB\s*(?:(?:LP)?DDR[345]x?\s*)?so-?dimm", k).try_cast("int")
    return part(1) + part(2)


def memory_slots(text: Column) -> Column:
    return F.coalesce(
        number(text, r"\b(\d)\s*(?:x\s*)?(?:ddr[45]\s*)?(?:csodimm|so-?dimm)\b", 0, 4),
        told(text, (r"no slots|no expansion|not upgrad(?:e)?able|\b0 slots|zero slots", 0), (r"soldered to systemboard(?!.*\b(?:so-?dimm|slot)\b)", 0), (r"\b(?:two|dual)\b.*\b(?:so-?dimm|slots?)\b", 2), (r"\b(?:one|single)\b\s+(?:ddr[45]\s*)?(?:so-?dimm|slot)", 1)).cast("int"),
        number(text, r"\b([1-4])\s*(?:x\s*)?slots?\b", 1, 4),
    )


def gigabytes(text: Column) -> Column:
    """A largest size: ``up to N GB`` or a leading N GB, terabytes of 1024."""
    each = found(text, r"(\d)\s*x\s*[^,\n]*?up to\s*\d+\s*tb\s*each").try_cast("int") * found(text, r"\d\s*x\s*[^,\n]*?up to\s*(\d+)\s*tb\s*each").try_cast("int") * 1024
    two = number(text, r"two\s+drives[^,\n]*?up to\s*(\d+)\s*tb\s*each", 1, 8) * 2048
    return F.coalesce(two, each, number(text, r"\b([1-8])\s*tb\b", 1, 8) * 1024, number(text, r"\b(\d{1,4})\s*gb?\b", 1, 9999))


def soldered(text: Column) -> Column:
    return told(text, (r"\b(?:soldered|on-?board|on\s+board|integrated|unified\s+memory|lpddr[45]x?)\b", True), (r"\b(?:so-?dimm|upgrad(?:e)?able|removable)\b", False)).cast("boolean")


def drive_interface(text: Column) -> Column:
    said = found(F.regexp_replace(text, "[™®]", ""), r"\b(pcie\s*(?:gen\s*)?[345](?:\.0)?(?:\s*x\s*[24])?(?:\s*nvme)?|nvme\s*(?:pcie\s*)?(?:gen\s*)?[345](?:\.0)?|nvme|sata)\b")
    generation = found(said, r"(?:pcie|nvme|gen)\s*(?:pcie\s*)?(?:gen\s*)?([345])")
    named = F.concat(F.lit("PCIe "), generation, F.lit(".0"), F.when(says(said, "nvme"), " NVMe").otherwise(""))
    return F.coalesce(named, told(said, ("nvme", "NVMe"), ("sata", "SATA III")))


def form_factor(text: Column) -> Column:
    return F.when(says(text, r"\b2\.5(?:-inch|\")"), "2.5-inch").otherwise(F.upper(F.regexp_replace(found(text, r"\b(m\.2(?:\s*(?:2280|2242|2230))?)"), r"\s+", " ")))


def drive_slots(text: Column) -> Column:
    """Several ``1 x M.2`` entries are counted; else words, else a number before M.2 or slots."""
    t = F.regexp_replace(text, r"(?i)\b(?:pcie\s*)?gen\s*[345](?:\.0)?(?:\s*x\s*[24])?\s*slots?\b", "m.2 slot")
    ones = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"\b(1)\s*[x×]?\s*m\.2[^\n,]*?slot")))
    return F.when(ones >= 2, ones).otherwise(F.coalesce(told(text, (r"\b(?:only\s+one|one\s+m\.2)\b", 1), (r"\b(?:extra\s+m\.2\s+slot|second\s+m\.2|two\s+drives|2x\s*m\.2|two\s+m\.2)\b", 2)).cast("int"), number(t, r"\b([1-4])\s*[x×]\s*m\.2", 1, 4), number(t, r"\b([1-4])\s*(?:m\.2\s*)?slots?\b", 1, 4)))


# Display, power, body

def response_ms(text: Column) -> Column:
    return number(text, r"(\d+(?:\.\d+)?)\s*ms\b", 0.01, 50, "double")


def gamut(text: Column) -> Column:
    return found(text, r"\b(\d{2,3}(?:\.\d+)?%\s*(?:sRGB|NTSC|DCI-P3|Adobe\s*RGB))\b")


def surface(text: Column) -> Column:
    return told(text, ("anti-reflect", "Anti-reflection"), ("anti[- ]glare|ag display", "Anti-glare"), ("matte|comfyview", "Matte"), ("glossy", "Glossy"))


def hdr(text: Column) -> Column:
    return F.trim(found(text, r"\b((?:VESA\s+)?DisplayHDR(?:\s+True\s+Black)?(?:\s*(?:1400|1000|600|500|400))?|Dolby\s*Vision|HDR\s*10\+?|HDR\s*(?:1400|1000|600|500|400))"))


def ratio(text: Column) -> Column:
    return found(text, r"\b(16:9|16:10|3:2|4:3|21:9)\b")


def cells(text: Column) -> Column:
    return F.coalesce(number(text, r"\b([2-6])\s*[- ]\s*cells?\b", 2, 6), number(text, r"cells?:\s*([2-6])\b", 2, 6))


def fast_charge(text: Column) -> Column:
    return F.coalesce(found(text, r"(\d+%\s*in\s*(?:about\s*)?\d+\s*min(?:utes)?)"), F.when(says(text, r"(?:fast|rapid)[- ]charg\w*") & ~denied(text), F.lit("Supported")))


def sizes_mm(text: Column) -> Column:
    """(width, depth, height) in millimetres from labels or a x b x c; centimetres are told by the unit or by the numbers."""
    label = lambda word: found(text, rf"\b{word}\b[^\d]*(\d+(?:\.\d+)?)").try_cast("double")
    cm = says(text, r"\d\s*cm\b")
    up = lambda v, most: F.when(cm & (v < most), v * 10).otherwise(v)
    labelled = F.struct(up(label("width"), 60).alias("w"), up(label("depth"), 60).alias("d"), up(label("height"), 10).alias("h"))
    triple = r"(\d+(?:\.\d+)?)\s*(?:mm|cm)?\s*[x×*]\s*(\d+(?:\.\d+)?)\s*(?:mm|cm)?\s*[x×*]\s*(\d+(?:\.\d+)?)"
    a, b, c = (found(text, triple, k).try_cast("double") for k in (1, 2, 3))
    small = (F.greatest(a, b, c) < 60) & (F.least(a, b, c) < 4.5)
    ten = F.when(cm | small, 10.0).otherwise(1.0)
    free = F.struct((a * ten).alias("w"), (b * ten).alias("d"), (c * ten).alias("h"))
    return F.when(label("width").isNotNull() & label("depth").isNotNull() & label("height").isNotNull(), labelled).when(c.isNotNull(), free)


def touch_row(text: Column) -> Column:
    return told(text, (r"\b(?:no|false|non-touch)\b", False), (r"yes|true|supported", True)).cast("boolean")


# Ports, system, build, sound


def system(text: Column) -> Column:
    """The operating system's name, after clauses in which a vendor recommends one are cut; plain Windows is the home edition."""
    t = F.regexp_replace(text, r"(?i)recommends?\s+windows\s*11\s*pro(?:\s+for\s+business)?", "")
    return told(t, (r"\bwindows\s*11\s*pro\b", "Windows 11 Pro"), (r"\bwin(?:dows)?\s*11\b", "Windows 11 Home"), (r"\bwindows\s*10\s*pro\b", "Windows 10 Pro"), (r"\bwindows\s*10\b", "Windows 10 Home"), (r"\bfree\s*dos\b", "FreeDOS"), (r"\b(?:no\s*(?:operating\s*system|preloaded|preinstalled|os)|without\s*os|eshell)\b", "No OS"), (r"\bdos\b", "FreeDOS"), (r"\bmacos\b", "macOS"), (r"\b(?:ubuntu|linux)\b", "Linux"))


def thunderbolt(text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Thunderbolt "), found(text, r"\bthunderbolt\s*([345])\b")), F.when(says(text, r"\bthunderbolt\b") & ~says(text, r"(?:no|without) thunderbolt"), F.lit("Thunderbolt")))


def bluetooth(text: Column) -> Column:
    v = found(text, r"\b(?:bluetooth|bt)\s*(?:v|version)?\s*([4-6](?:\.[0-4])?)\b")
    return F.concat(F.lit("Bluetooth "), v, F.when(v.contains("."), "").otherwise(".0"))


def card_reader(text: Column) -> Column:
    return F.when(text.isNotNull(), ~denied(text))


def card_kind(text: Column) -> Column:
    return F.coalesce(told(text, (r"\bsd\s*express\b", "SD Express"), (r"\bmicro-?sd\b", "MicroSD")), F.concat(found(text, r"\b(\d-in-1)\b"), F.lit(" Card Reader")), told(text, (r"\bsd\b", "SD Card Reader")))


def port_list(text: Column) -> Column:
    """Entries between semicolons or line ends, or commas outside brackets, without dates, slogans and wireless standards."""
    entries = F.flatten(F.transform(F.split(text, "\n"), lambda t: F.split(F.when(t.contains(";"), t).otherwise(F.regexp_replace(t, r",\s*(?![^()]*\))", ";")), ";")))
    entries = F.filter(F.transform(entries, tidy), lambda p: p.isNotNull())
    wired = r"\b(?:usb|thunderbolt|hdmi|rj[- ]?45|ethernet|jack|card\s*reader|microsd|sd\s+card|displayport|dc-in|vga|lan)\b"
    fine = lambda p: ~says(p, r"\b20\d\d[-/]\d\d[-/]\d\d\b|end of support|lifecycle|warranty|all the ports you need|built to dominate|connect with ease|stylus support|support(?:ed)? (?:ssd|list)|^0$") & (says(p, wired) | ~says(p, r"\b(?:wi-?fi|wlan|bluetooth|802\.11|refresh\s*rate)\b"))
    kept = F.filter(entries, fine)
    return F.when(F.size(kept) > 0, kept)


def backlight(text: Column) -> Column:
    """Kind of the keyboard's light; ``none`` is a word of denial, which goes first."""
    return told(text, (r"\b(?:non-?backlit|(?:no|not|without)\s*backli(?:t|ght))\b", "none"), (r"\bper-?key\s*rgb\b", "Per-Key RGB"), (r"\b4-?zone\s*rgb\b", "4-Zone RGB"), (r"\b(?:1-?zone|single\s*zone)\s*rgb\b", "1-Zone RGB"), (r"\brgb\b", "RGB Backlit"), (r"\bamber\b", "Amber Backlit"), (r"\bwhite\s+backli(?:t|ght)\b", "White Backlit"), (r"\bbackli(?:t|ght)\b", "Backlit"))


def numpad(text: Column) -> Column:
    return told(text, (r"\b(?:without|no)\s+(?:numeric\s*keypad|num-?key|numpad)\b", False), (r"\b(?:num-?key|numeric\s*keypad|numpad|number\s*pad)\b", True)).cast("boolean")


def fingerprint(text: Column) -> Column:
    return told(text, (r"\b(?:no|without)\s+fingerprint\b|fingerprint[^\n]*:\s*(?:no|none|n/a|not)\b|^(?:no|none)$", False), (r"\bfingerprint\b", True)).cast("boolean")


def material(text: Column) -> Column:
    return F.when(~says(text, r"secured-core|security|tpm|password|fingerprint|clamshell|convertible|classical|gaming laptop|notebook|2-in-1|detachable|\bips\b"), tidy(text))


def security_list(text: Column) -> Column:
    kept = F.filter(F.transform(F.split(text, "\n"), tidy), lambda t: t.isNotNull() & ~says(t, r"^(?:no|without)\b|n/a"))
    return F.when(F.size(kept) > 0, kept)


def webcam(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(found(text, r"\b(\d{3,4}\s*p|\d+(?:\.\d+)?\s*MP)\b"), r"\s+", ""), told(text, (r"\b(?:full\s*hd|fhd)\b", "1080p"), (r"\bqhd\b", "1440p"), (r"\b(?:uhd|4k)\b", "2160p"), (r"\bhd\b", "720p")))


def shutter(text: Column) -> Column:
    return told(text, (r"\b(?:without|no)\s+(?:privacy\s*shutter|e-?shutter)\b", False), (r"\b(?:privacy|camera|webcam)\s*shutter\b|\be-?shutter\b", True)).cast("boolean")


def infrared(text: Column) -> Column:
    return told(text, (r"\b(?:without|no)\s+(?:ir|infrared)\b", False), (r"\b(?:ir\s*(?:camera|webcam|function)|infrared|windows\s*hello\s*camera)\b", True)).cast("boolean")


def microphone(text: Column) -> Column:
    return told(text, (r"\bbuilt-in\s*microphones?\s*[:=]?\s*2\b|\bdual\s*array\b", "Dual array microphone"), (r"\bmicrophone\s*[:=]?\s*(?:yes|1|built-in)\b", "Built-in microphone"))


def speaker_count(text: Column) -> Column:
    units = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\d+)\s*(?:woofers?|tweeters?)")), lambda n: n.cast("int"))
    total = F.aggregate(units, F.lit(0), lambda s, n: s + n)
    return F.when(F.size(units) >= 2, total).otherwise(F.coalesce(number(text, r"(\d)[-\s]*(?:stereo\s*)?(?:x\s*\d+(?:\.\d+)?\s*W|speakers?)", 1, 9), told(text, (r"\b(?:quad|four|4x)\b", 4), (r"\b(?:dual|stereo|two|2x)\b", 2)).cast("int")))
