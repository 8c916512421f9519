"""What titles say about products: one table of wordings.

All patterns, words and written forms are fixed values: they must match the wording of the
shops. A rule names an attribute and its wordings in order; the first that a title has
gives the value. How a wording is read is in ``functions/title_attributes.py``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Find:
    """The first match of a pattern, as text: its group (or groups 1 and 2 joined), cased, shortened, named."""

    pattern: str
    case: str = ""  # upper, lower, title
    before: str = ""
    after: str = ""
    group: int = 1
    join: str | None = None
    drop: str = ""  # what goes from the match
    names: Mapping[str, str] | None = None  # values of certain matches, without before and after
    closed: bool = False  # matches without a name say nothing
    folded: bool = False  # compare folded
    number: bool = False  # no leading zeros, a point as decimal mark
    least: int = 0


@dataclass(frozen=True)
class Flag:
    """A value that a wording stands for."""

    pattern: str
    value: str = "true"
    folded: bool = False


@dataclass(frozen=True)
class Measure:
    """A quantity with its unit, if the title also has ``needs``."""

    kind: str  # capacity, wattage
    needs: str = ""


@dataclass(frozen=True)
class Rule:
    attribute: str
    wordings: tuple
    only: tuple[str, ...] = ()  # categories; titles of unknown category count as well
    strictly: tuple[str, ...] = ()  # categories; only these
    needs: str = ""  # a wording that stands in for the category


MEMORY_TYPE = r"(?i)\b(LPDDR[345]X?|DDR[345]|GDDR\d+|HBM\d*)\b"
LIQUID = (
    r"(?i)\b(?:water\s*cooler|aio|liquid\s+(?:cpu\s+)?cooler|cpu\s+liquid\s+cooler|liquid\s+cooling|cooler\s+(?:l[ií]quido|de\s+agua)"
    r"|refrigeraci[oó]n\s+l[ií]quida)\b"
)
RESOLUTION = r"(?i)\b(8K|4K|UHD|QHD|WQHD|FHD|Full\s*HD|HD|1080p|1440p|2160p|7680p)\b"

GENERAL = (
    Rule("size", (Find(r"(?i)\b(?:size|tamanho|tamaño)\s*[:\-]?\s*(XXL|XL|L|M|S|XS|\d{1,2})\b", "upper"),)),
    Rule("memory_type", (Find(MEMORY_TYPE, "upper"),)),
    Rule("frequency", (Find(r"(?i)\b(\d{3,5})\s*(?:MHz|MT/?s)\b", number=True, after=" MHz"),), only=("ram", "cpu"), needs=MEMORY_TYPE),
    Rule("cas_latency", (Find(r"(?i)\bCL\s*(\d{1,2})\b", number=True, before="CL"),)),
    Rule("connectivity", (Find(r"(?i)\b(5G|4G|Wi-?Fi\s*[67]?|Bluetooth)\b", "upper", names={"5G": "5G", "4G": "4G"}, closed=True),)),
    Rule("socket", (Find(r"(?i)\b(AM[45]|s?TRX4|TR4|LGA\s?17\d{2}|LGA\s?12\d{2}|LGA\s?1151)\b", "upper", drop=" "),)),
    Rule("chipset", (Find(r"(?i)\b([ABZHX](?:650|670|690|790|870|610|510|550|570)M?(?:-Plus)?)\b", "upper"),), only=("motherboard",)),
    Rule("wifi", (Flag(r"(?i)\bWi-?Fi\b"),)),
    Rule("cores", (Find(r"(?i)\b(\d{1,2})\s*[- ]?Cores?\b"),)),
    Rule("threads", (Find(r"(?i)\b(\d{1,2})\s*[- ]?Threads?\b"),)),
    Rule("gpu_model", (Find(r"(?i)\b((?:GeForce\s+)?RTX\s*\d{3,4}\s*(?:Ti|SUPER)?|(?:Radeon\s+)?RX\s*\d{3,4}\s*(?:XT)?)\b"),)),
    Rule("wattage", (Find(r"(?i)\b(\d{3,4})\s*W(?:att)?s?\b", number=True, least=300, after=" W"),), only=("psu",)),
    Rule("efficiency", (Find(r"(?i)\b80\s*(?:Plus|\+)\s+(Titanium|Platinum|Gold|Silver|Bronze)\b", "title", before="80 Plus "),)),
    Rule("modularity", (Find(
        r"(?i)\b(Full(?:y)?\s+Modular|Semi[\s-]?Modular|Non[\s-]?Modular)\b", "title",
        names={"Fully Modular": "Full Modular", "Semi-modular": "Semi-Modular", "Non-modular": "Non-Modular"},
    ),)),
    Rule("form_factor", (Find(r"(?i)\b(M\.2|mATX|ATX|ITX|E-ATX|SODIMM|DIMM|2\.5\"|3\.5\")\b", "upper", names={"MATX": "mATX"}),)),
    Rule("interface", (Find(r"(?i)\b(NVMe|SATA(?:\s*III)?|PCIe|USB-?C)\b", "upper", names={"NVME": "NVMe", "SATA III": "SATA"}),)),
    Rule("pcie_generation", (
        Find(r"(?i)\bPCIe?\s*(?:Gen\s*)?([45]\.\d)\b", before="PCIe "), Find(r"(?i)\bPCIe?\s*(?:Gen\s*)?([45])\b", before="PCIe ", after=".0"),
        Find(r"(?i)\bPCIE([45])\b", before="PCIe ", after=".0"),
    )),
    Rule("refresh_rate", (Find(r"(?i)\b(\d{2,3})\s*Hz\b", number=True, least=60, after=" Hz"),), only=("monitor", "tv", "notebook")),
    Rule("resolution", (Find(RESOLUTION, "upper", names={"FULL HD": "FHD"}),)),
    Rule("panel", (Find(r"(?i)\b(OLED|QLED|IPS|VA|TN|Mini-?LED|Micro-?LED)\b", "upper", names={"MINI-LED": "Mini-LED"}),)),
    Rule("cooler_type", (Flag(LIQUID, "liquid"), Flag(r"(?i)\b(?:Air\s*Cooler|Cooler\s*a[eé]reo)\b", "air"))),
    Rule("radiator_size", (Find(r"(?i)\b(120|240|280|360|420)\s*mm\b", after=" mm"),), only=("cooler",), needs=LIQUID),
    Rule("radiator_size", (Find(r"(?i)\b(120|240|280|360|420)\b", after=" mm"),), strictly=("cooler",)),
    Rule("rpm", (Find(r"(?i)\b(5400|7200)\s*RPM\b", after=" RPM"),)),
    Rule("overclocked", (Flag(r"(?i)\bOC\b|\bOverclock(?:ed)?\b"),), only=("gpu",)),
)

WIFI = Rule("wifi", (
    Find(r"(?i)\bwi-?fi\s*(6e|7|6|5|4)\b", "upper", before="Wi-Fi "),
    Find(r"(?i)\b802\.11\s*(ax|ac|be|n)\b", "lower", names={"be": "Wi-Fi 7", "ax": "Wi-Fi 6", "ac": "Wi-Fi 5", "n": "Wi-Fi 4"}),
    Flag(r"(?i)\bwi-?fi\b", "Wi-Fi"),
))
SCREEN_RESOLUTION = Rule("resolution", (
    Find(r"(?i)\b(8k|4k|1440p|1080p|720p|qhd|uhd|fhd|full\s*hd)\b", "upper", names={"FULL HD": "FHD"}),
    Find(r"\b(\d{3,4})\s*[x×]\s*(\d{3,4})\b", join="x"),
))
CONNECTION = Rule("connectivity", (Find(
    r"(?i)\b(wireless|sem\s*fio|bluetooth|wired|com\s*fio|usb|p2|3\.5\s*mm|xlr)\b", folded=True, closed=True,
    names={
        "wireless": "Wireless", "sem fio": "Wireless", "semfio": "Wireless", "wired": "Wired", "com fio": "Wired", "comfio": "Wired",
        "bluetooth": "Bluetooth", "usb": "USB", "p2": "P2", "3.5 mm": "P2", "3.5mm": "P2", "xlr": "XLR",
    },
),))
COLOR = Rule("color", (Find(r"(?i)\b(preto|black|branco|white|cinza|gray|grey|azul|blue|vermelho|red)\b", "title"),))
POE = Rule("poe", (Flag(r"(?i)\bpoe\+?\b|\bpower over ethernet\b"),))
MOUNT = Rule("mount", (Find(r"(?i)\b(sony\s*e|fuji\s*x|canon\s*rf|canon\s*ef|nikon\s*z|mft|micro\s*4/3|l-mount|e-mount|rf-mount|z-mount)\b", "title"),))
POWER = Rule("wattage", (Measure("wattage"),))
CAPACITY = Rule("capacity", (Measure("capacity"),))
USB = r"(?i)\busb\s*(4|3\.2|3\.1|3\.0|2\.0|c)\b|\busb-c\b"
USB_WORDINGS = (Find(USB, "upper", before="USB ", names={"C": "USB-C"}), Flag(USB, "USB-C"))
HDMI, DISPLAYPORT = r"(?i)\bhdmi\b", r"(?i)\bdisplayport\b|\bdp\s*(?:2\.1|1\.4)\b"
PLUG = (Flag(HDMI, "HDMI"), Flag(DISPLAYPORT, "DisplayPort"))
NETWORK_CABLE = Find(r"(?i)\bcat\.?\s*(5e|6a|6|7|8)\b", "upper", before="Cat")
CHARGER = (
    POWER,
    Rule("port_count", (Find(r"(?i)\b([1-4])\s*(?:portas?|ports?)\b", number=True),)),
    Rule("usb_pd", (Flag("pd|power delivery", folded=True),)),
)
DESK_SIZE = r"\b(\d{2,3})\s*[x×]\s*(\d{2,3})\b"

#: The rules of a category; they win over the general ones. Printers and scanners are told
#: apart by part number alone, which titles do not give.
BY_CATEGORY: dict[str, tuple[Rule, ...]] = {
    "router": (WIFI, Rule("pack_count", (
        Find(r"(?i)\b([1-3])\s*[- ]?(?:pack|unidade|unidades|node|nodes|kit)\b", number=True), Find(r"(?i)\bkit\s*([1-3])\b", number=True),
    ))),
    "access_point": (WIFI, POE),
    "wifi_adapter": (
        WIFI,
        Rule("interface", (Flag("pcie|pci-e", "PCIe", folded=True), Flag("usb", "USB", folded=True))),
        Rule("bluetooth", (Flag(r"bluetooth|\bbt\b", folded=True),)),
    ),
    "network_switch": (
        Rule("port_count", (Find(r"(?i)\b(\d{1,2})\s*[- ]?(?:portas?|ports?)\b", number=True),)),
        Rule("port_speed", (Find(
            r"(?i)\b(10g|2\.5g|1g|gigabit|1000|100)\b", "lower",
            names={"10g": "10 GbE", "2.5g": "2.5 GbE", "1g": "1 GbE", "gigabit": "1 GbE", "1000": "1 GbE", "100": "100 Mbps"},
        ),)),
        POE,
        Rule("managed", (Flag("gerenciavel|managed", folded=True),)),
    ),
    "webcam": (SCREEN_RESOLUTION, Rule("fps", (Find(r"(?i)\b(\d{2,3})\s*fps\b", number=True, after=" FPS"),))),
    "microphone": (CONNECTION,),
    "speaker": (Rule("channels", (Find(r"(?i)\b(2\.1|5\.1|7\.1|mono|stereo)\b"),)),),
    "projector": (SCREEN_RESOLUTION,),
    "smartwatch": (
        Rule("case_size", (Find(r"(?i)\b(40|41|42|44|45|46|49)\s*mm\b", after=" mm"),)),
        Rule("connectivity", (Flag("cellular|lte", "GPS + Cellular", folded=True), Flag("gps", "GPS", folded=True))),
    ),
    "camera": (MOUNT, Rule("kit", (
        Flag(r"(?i)\bbody\s*only\b|\bsomente\s+corpo\b|\bcorpo\b", "body-only"), Flag(r"(?i)\bkit\b|\bcom\s+lente\b", "kit"),
    ))),
    "lens": (MOUNT, Rule("focal_length", (
        Find(r"(?i)\b(\d{1,3}(?:[.,]\d+)?)\s*(?:-|–|a|to)?\s*(\d{1,3}(?:[.,]\d+)?)?\s*mm\b", join="-", after=" mm"),
    ))),
    "memory_card": (CAPACITY,),
    "usb_drive": (CAPACITY,),
    "nas": (
        Rule("bay_count", (Find(r"(?i)\b([1-8])\s*[- ]?(?:bay|baia|baias)\b", number=True),)),
        Rule("included_storage", (Flag(r"(?i)\bdiskless\b|\bsem\s+disco\b|\bsem\s+hd\b", "diskless"), Measure("capacity", needs="com |populated|hdd|incluido"))),
    ),
    "ups": (Rule("va", (Find(r"(?i)\b(\d{3,4})\s*va\b", number=True, after=" VA"),)), POWER),
    "power_strip": (
        Rule("power", (Measure("wattage"),)), Rule("outlet_count", (Find(r"(?i)\b(\d{1,2})\s*(?:tomadas?|outlets?)\b", number=True),)),
    ),
    "charger": CHARGER,
    "laptop_charger": (*CHARGER, Rule("voltage", (Find(r"(?i)\b(\d{1,2}(?:[.,]\d+)?)\s*v\b", join="", after=" V"),))),
    "dock": (Rule("thunderbolt", (Find(r"(?i)\bthunderbolt\s*(5|4|3)\b", before="Thunderbolt "),)), Rule("usb_generation", USB_WORDINGS)),
    "cable": (
        Rule("length", (Measure("length"),)),
        Rule("standard", (
            NETWORK_CABLE, Find(r"(?i)\bhdmi\s*(2\.1|2\.0|1\.4)", before="HDMI "), Flag(HDMI, "HDMI"),
            Find(r"(?i)\bdisplayport\s*(2\.1|2\.0|1\.4)", before="DisplayPort "), Find(r"(?i)\bdp\s*(2\.1|1\.4)\b", before="DisplayPort "),
            Flag(DISPLAYPORT, "DisplayPort"), *USB_WORDINGS,
        )),
        Rule("connector_a", PLUG),
        Rule("connector_b", PLUG),
        Rule("ethernet_category", (NETWORK_CABLE,)),
    ),
    "chair": (COLOR,),
    "desk": (
        Rule("width", (Find(DESK_SIZE, after=" cm"), Find(r"(?i)\b(\d{2,3})\s*(?:cm|mm)?\s*(?:largura|width|w)\b", after=" cm"))),
        Rule("depth", (Find(DESK_SIZE, group=2, after=" cm"),)),
    ),
    "monitor_mount": (
        Rule("vesa", (Find(r"(?i)\bvesa\s*(\d{2,3}\s*[x×]\s*\d{2,3}|\d{2,3})\b", "upper", drop=r"\s"),)),
        Rule("arm_count", (
            Find(r"(?i)\b([1-4])\s*[- ]?(?:braco|braço|arm|arms|monitor)\b", number=True), Flag(r"(?i)\bdual\b|\bduplo\b", "2"), Flag(r"(?i)\btriple\b|\btriplo\b", "3"),
        )),
    ),
    "fan": (
        Rule("fan_size", (Find(r"(?i)\b(120|140|200)\s*mm\b", after=" mm"),)),
        Rule("fan_count", (Find(r"(?i)\b(?:kit|pack)\s*([2-6])\b", number=True), Find(r"(?i)\b([2-6])\s*(?:fans?|ventoinhas?)\b", number=True))),
    ),
    "keyboard": (
        Rule("switch_type", (
            Find(r"(?i)\b(red|brown|blue|black|silent|linear|tactile)\s*switch\b", "title", after=" Switch"),
            Find(r"(?i)\bswitch\s*(red|brown|blue|black)\b", "title", after=" Switch"),
        )),
        Rule("layout", (Find(r"(?i)\b(abnt2|ansi|iso|tkl|full\s*size)\b|\b(?:60|65|75)%", "upper", group=0, names={"FULL SIZE": "Full Size"}),)),
    ),
    "mouse": (CONNECTION, COLOR),
    "headset": (CONNECTION,),
    "gamepad": (
        Rule("platform", (Find(r"(?i)\b(ps5|ps4|xbox|pc|switch|android|ios)\b", "upper"),)),
        Rule("edition", (Find(r"(?i)\b(edge|elite|pro|standard|core)\b", "title", names={"Edge": "Edge", "Elite": "Elite", "Pro": "Pro"}, closed=True),)),
        CONNECTION,
    ),
    "case": (COLOR,),
}
