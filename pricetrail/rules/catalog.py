"""Word lists, lookup tables and patterns of the catalog. All fixed values."""

from __future__ import annotations

# --- colours ----------------------------------------------------------------------------------

# colour word (pt, en, es, fr) -> the one name compared
COLORS = {
    "preto": "black", "preta": "black", "black": "black", "negro": "black", "negra": "black", "noir": "black",
    "titanio preto": "black", "titanium black": "black", "black titanium": "black",
    "titanio branco": "white", "titanium white": "white", "white titanium": "white",
    "titanio cinza": "gray", "titanium gray": "gray", "titanium grey": "gray", "gray titanium": "gray", "grey titanium": "gray",
    "branco": "white", "branca": "white", "white": "white", "blanco": "white", "blanca": "white", "blanc": "white",
    "azul": "blue", "blue": "blue", "vermelho": "red", "red": "red", "rojo": "red", "verde": "green", "green": "green",
    "verde acinzentado": "teal", "verde acizentado": "teal", "teal": "teal",
    "ultramarino": "ultramarine", "ultramarine": "ultramarine",
    "dourado": "gold", "gold": "gold", "rose gold": "rosegold", "rosegold": "rosegold", "ouro rosa": "rosegold",
    "prateado": "silver", "prata": "silver", "silver": "silver",
    "cinza": "gray", "cinza espacial": "gray", "space gray": "gray", "space grey": "gray",
    "luna grey": "gray", "luna gray": "gray", "arctic grey": "gray", "arctic gray": "gray",
    "platinum grey": "gray", "platinum gray": "gray", "storm grey": "gray", "storm gray": "gray",
    "gray": "gray", "grey": "gray", "rosa": "pink", "pink": "pink", "roxo": "purple", "purple": "purple",
    "lavanda": "lavender", "lavender": "lavender", "titanio": "titanium", "titanium": "titanium",
    "orange": "orange", "laranja": "orange", "naranja": "orange", "sage": "sage",
    "burgundy": "burgundy", "vinho": "burgundy", "bordo": "burgundy", "bordeaux": "burgundy", "borgona": "burgundy", "burdeos": "burgundy",
    "glacier": "glacier", "glacial": "glacier", "glaciar": "glacier",
    "midnight": "midnight", "starlight": "starlight", "graphite": "graphite",
    "sierra blue": "sierra blue", "alpine green": "alpine green", "midnight black": "midnight black",
    "desert titanium": "desert titanium", "natural titanium": "natural titanium",
    "deep blue": "deep blue", "deep purple": "deep purple",
}
COLOR_FAMILY = {
    "sage": "green", "alpine green": "green", "burgundy": "red", "glacier": "blue", "sierra blue": "blue",
    "deep blue": "blue", "deep purple": "purple", "midnight": "black", "midnight black": "black",
    "starlight": "white", "graphite": "gray", "desert titanium": "beige", "natural titanium": "beige",
}
COLOR_FINISHES = {
    "cosmic": "cosmic", "cosmico": "cosmic", "cosmica": "cosmic", "space": "space", "espacial": "space",
    "deep": "deep", "intenso": "deep", "intensa": "deep", "dark": "dark", "escuro": "dark", "escura": "dark",
    "light": "light", "claro": "light", "clara": "light", "arctic": "arctic", "artico": "arctic", "artica": "arctic",
}
HUES = sorted(set(COLORS.values()))
FINISH_ONLY = ("titanium",)
FINISH_HUES = ("black", "white", "gray")
COLOR_SEARCH_LABELS = {
    "black": {"en": "black", "pt": "preto", "es": "negro"}, "white": {"en": "white", "pt": "branco", "es": "blanco"},
    "blue": {"en": "blue", "pt": "azul", "es": "azul"}, "red": {"en": "red", "pt": "vermelho", "es": "rojo"},
    "green": {"en": "green", "pt": "verde", "es": "verde"},
    "teal": {"en": "teal", "pt": "verde acinzentado", "es": "verde azulado"},
    "pink": {"en": "pink", "pt": "rosa", "es": "rosa"}, "purple": {"en": "purple", "pt": "roxo", "es": "morado"},
    "gray": {"en": "gray", "pt": "cinza", "es": "gris"}, "gold": {"en": "gold", "pt": "dourado", "es": "dorado"},
    "silver": {"en": "silver", "pt": "prata", "es": "plateado"}, "orange": {"en": "orange", "pt": "laranja", "es": "naranja"},
    "burgundy": {"en": "burgundy", "pt": "bordo", "es": "burdeos"},
}
TITLE_COLORS = (
    "black white blue red green gold silver pink purple yellow orange gray grey brown beige navy midnight starlight "
    "graphite titanium natural cream lavender lilac coral teal ivory champagne spacegray spacegrey preto branco azul "
    "vermelho verde dourado prateado rosa roxo amarelo laranja cinza marrom titânio titanio lavanda lilas lilás negro "
    "blanco rojo amarillo gris plateado dorado"
).split()
METAL_COLORS = "gold silver titanium platinum bronze dourado prateado dorado".split()

# --- variants ---------------------------------------------------------------------------------

VARIANT_KEYS = ("color", "storage", "size", "capacity", "ram", "pack", "network_lock")
VARIANT_KEY_ALIASES = {
    "colour": "color", "cor": "color", "color": "color",
    "armazenamento": "storage", "capacidade": "storage", "capacidade_de_armazenamento": "storage",
    "memoria_interna": "storage", "memoria": "storage", "internal_storage": "storage", "storage": "storage",
    "capacity": "capacity", "tamanho": "size", "size": "size", "ram": "ram", "memoria_ram": "ram",
    "pack": "pack", "embalagem": "pack",
    "network_lock": "network_lock", "carrier_status": "network_lock", "carrier_lock": "network_lock",
}
LOCK_WORDS = {
    "unlocked": "unlocked", "desbloqueado": "unlocked", "desbloqueada": "unlocked", "liberado": "unlocked",
    "liberada": "unlocked", "locked": "locked", "bloqueado": "locked", "bloqueada": "locked",
}
UNLOCKED_CARRIERS = ("unlocked", "carrier unlocked", "sim free")
WIFI_LABELS = (
    "wifi", "wi-fi", "wi fi", "wireless", "wifi 6", "wifi 6e", "wifi 7", "wi-fi 6", "wi-fi 6e", "wi-fi 7",
)
RAM_LIKE_MAX_GB = 64
STORAGE_LIKE_MIN_GB = 128

# --- titles -----------------------------------------------------------------------------------

# phrases of other languages -> one word
TITLE_ALIASES = {
    "unlocked": ["fully unlocked", "desbloqueado", "desbloqueada", "liberado", "liberada"],
    "locked": ["bloqueado", "bloqueada"],
    "wireless": ["sem fio", "sin cables", "inalambrico", "inalambrica", "sans fil"],
    "wired": ["com fio", "con cable", "cableado", "cableada", "avec fil"],
    "refurbished": ["renewed", "reconditioned", "reacondicionado", "reacondicionada", "recondicionado", "recondicionada"],
    "used": ["usado", "usada", "usados", "usadas", "seminovo", "seminova"],
    "openbox": ["open box", "caja abierta", "caixa aberta"],
    "new": ["nuevo", "nueva", "novo", "nova", "neuf", "neuve"],
}
TITLE_STOPWORDS = (
    "oferta promo promocao promoção frete gratis grátis envio novo nova original oficial kit com para the and de da do das "
    "dos em na no a o e ou nvidia geforce radeon placa video vídeo dlss ray tracing fp4 pcie pci express mhz gbps bit "
    "displayport hdmi"
).split()
CONDITION_WORDS = (
    "renewed", "refurbished", "recondicionado", "recondicionada", "reacondicionado", "reacondicionada", "reconditioned",
    "renovado", "renovada", "usado", "usada", "usados", "usadas", "used", "cpo", "open box", "open-box", "caja abierta",
    "caixa aberta", "seminovo", "seminova",
)
ACCESSORY_WORDS = (
    "capa case pelicula película cabo carregador charger suporte cover skin protetor protector film adapter adaptador "
    "bolsa pouch"
).split()
BUNDLE_MARKERS = (
    "smartwatch", "apple watch", "galaxy watch", "galaxy fit", "galaxy buds", "buds3", "buds 3", "fit3", "fit 3", "airpods",
    "bundle", "kit ", " combo", "com fone", "com watch", "+ watch", "+ airpods", "fortnite", "gran turismo", "astro bot",
    "spider-man", "spiderman", "wolverine", "god of war", "horizon forbidden", "com 2 jogos", "2 jogos", "+ jogo", "+ game",
    "two games",
)
SYSTEM_WORDS = ("notebook", "laptop", "ultrabook", "chromebook", "minipc", "mini pc", "all in one", "all-in-one")
CARD_MARKERS = (
    "gddr", "windforce", "gaming oc", "eagle", "aero", "dual oc", "shadow", "ventus", "tuf", "aorus", "geforce", "radeon",
)
PLACEHOLDER_BRANDS = (
    "outros", "other", "others", "generico", "n a", "na", "amazon renewed store", "amazon renewed", "renewed",
)
BRAND_ALIASES = {
    "asustek": "ASUS", "asustek computer": "ASUS", "asus computer": "ASUS",
    "micro-star international": "MSI", "micro star international": "MSI",
    "hewlett packard": "HP", "hewlett-packard": "HP", "hp inc": "HP", "lenovo group": "Lenovo",
    "samsung electronics": "Samsung", "apple computer": "Apple", "apple inc": "Apple",
    "amd advanced micro devices": "AMD", "advanced micro devices": "AMD", "intel corporation": "Intel",
    "nvidia corporation": "NVIDIA", "corsair memory": "Corsair", "kingston technology": "Kingston",
    "western digital": "WD", "wdc": "WD",
}
MODEL_NOISE_ENDINGS = (
    "everydaylaptop", "intelcore", "amdryzen", "windows11", "windows10", "processor", "laptop", "notebook",
)
MODEL_FAMILIES = (
    "ideapad", "thinkpad", "iphone", "galaxy", "macbook", "vivobook", "pavilion", "inspiron", "nitro", "legion", "evoplus",
    "evopro", "playstation", "rtx", "gtx", "rx",
)
SEARCH_NOISE = (
    "placa video ray tracing dlss fp4 mhz bit bits cache 100mb pcie pci express celular smartphone telefone ai cam camera "
    "cameras quadrupla tripla bateria battery mah dual chip mp ios android tela display polegadas inch inches 5g 4g lte "
    "wifi6 wifi6e wifi7"
).split()
CATEGORY_SEARCH_LABELS = {
    "gpu": {"pt": "placa de video", "en": "graphics card", "es": "tarjeta grafica"},
    "cpu": {"pt": "processador", "en": "processor", "es": "procesador"},
    "motherboard": {"pt": "placa mae", "en": "motherboard", "es": "placa base"},
    "monitor": {"pt": "monitor", "en": "monitor", "es": "monitor"},
    "smartphone": {"pt": "celular", "en": "smartphone", "es": "telefono"},
    "ssd": {"pt": "ssd", "en": "ssd", "es": "ssd"},
    "psu": {"pt": "fonte", "en": "power supply", "es": "fuente de alimentacion"},
}

# --- part numbers (folded text) ---------------------------------------------------------------

PART_NUMBERS = (
    r"\b\d{3}-[a-z0-9]{5,}(?:-[a-z0-9]{2,})+\b",
    r"\b100[-\s]?(?:100000|000000)\d{3}[a-z]{0,3}\b",
    r"\b[a-z]{2,4}\d[a-z0-9]{2,8}/[a-z]{1,3}\b",
    r"\bmz[-\s]?[a-z]\d[a-z0-9]{4,}(?:/[a-z]{2})?\b",
    r"\bsm-?[a-z]?\d{3}[a-z0-9]*(?:/[a-z]{2})?\b",
    r"\bcfi[-\s]?\d{4}[a-z]?\b",
    r"\bhx\d{3}[a-z0-9]{4,}\b",
    r"\b\d{3}-v\d{3}-\d{3}\b",
    r"\bg\d{4}-\d{1,2}[a-z0-9]{2,4}\b",
    r"\b(?=[a-z0-9-]{8,}\b)(?=[a-z]{2,5}-[a-z0-9-]*[a-z])(?=[a-z]{2,5}-[a-z0-9-]*\d)[a-z]{2,5}-[a-z0-9-]{4,}\b",
    r"\b(?=[a-z0-9-]*\d)[a-z]{2,}(?:-[a-z0-9]{1,16}){2,}\b",
    r"\b90mb[a-z0-9]+-[a-z0-9]+\b",
)
COMPACT_PART_NUMBER = r"\b[a-z]{2,5}\d{4,}\b"
PART_NUMBER_LABELS = (
    "referencia", "reference", "mpn", "part number", "manufacturer part number", "manufacturer sku", "sku do fabricante",
    "codigo do fabricante", "manufacturer code",
)
MODEL_NUMBER_LABELS = ("model number", "numero do modelo", "numero de modelo", "manufacturer model number")

# --- graphics cards ---------------------------------------------------------------------------

GPU_NOISE = (
    "placa video vídeo gpu graphics card nvidia geforce radeon gddr5 gddr6 gddr7 gddr6x hbm hbm2 hbm3 pcie pci express bit "
    "bits mhz ghz gbps dlss ray tracing fp4 hdmi displayport nvenc rgb argb de da do com para e and the of a o"
).split()
GPU_LINES = (
    "dual prime tuf strix shadow ventus windforce eagle aorus gaming trio rog oc edition sff founders liquid inspire suprim "
    "vanguard expert infinity phoenix challenger turbo aero white solid ampere trinity master elite soc x"
).split()
VARIANT_MODIFIERS = ("oc", "edition", "overclock", "overclocked", "edicao", "edição")
CHIP_VENDORS = ("nvidia", "amd")
BOARD_BRANDS = (
    "asus msi gigabyte palit zotac pny sapphire powercolor xfx asrock evga gainward galax inno3d leadtek maxsun yeston "
    "sparkle colorful manli biostar afox onix intel acer lenovo dell hp corsair nzxt"
).split()
KNOWN_MODEL_WORDS = (
    "iphone", "galaxy", "rtx", "gtx", "ryzen", "ideapad", "playstation", "ps5", "ps4", "xbox", "cfi",
)

# --- categories -------------------------------------------------------------------------------

# category, priority (lower is tested first), needles in the lower-case title
CATEGORIES = [
    ("gpu", 40, ["rtx", "gtx", "radeon", "geforce", "placa de vídeo", "placa de video"]),
    ("ram", 50, ["ddr4", "ddr5", "dimm", "sodimm", "fury", "vengeance", "memoria ram", "memória ram"]),
    ("motherboard", 20, ["placa-mãe", "placa-mae", "placa mae", "motherboard", "b650", "z790", "x870", "a620", "b550", "x670"]),
    ("cpu", 30, ["ryzen", "core i3", "core i5", "core i7", "core i9", "processador"]),
    ("smartphone", 15, ["iphone", "galaxy", "celular", "smartphone", "pixel", "xiaomi", "redmi"]),
    ("tablet", 18, ["ipad", "tablet", "galaxy tab"]),
    ("ssd", 45, ["nvme", " m.2", "ssd", "hdd", "barracuda", "980 pro", "990 pro"]),
    ("notebook", 10, ["notebook", "laptop", "ultrabook", "macbook", "rog strix g", "strix g16", "strix g15", "zephyrus",
                      "ideapad", "thinkpad", "vivobook", "legion ", "nitro v", "predator helios", "tuf gaming a", "tuf gaming f"]),
    ("psu", 55, ["fonte", "psu", "power supply", "80 plus", "80+", "full modular", "semi modular"]),
    ("cooler", 25, ["water cooler", "aio", "liquid cooler", "air cooler", "cpu cooler", "h150i", "h100i", "h170i", "icue",
                    "ak620", "peerless assassin", "nh-d15", "kraken"]),
    ("fan", 70, ["case fan", "ventoinha", "sickleflow", "fan pack", "kit 3 fans"]),
    ("monitor", 35, ["monitor", "ultragear"]),
    ("tv", 38, ["smart tv", " oled ", " qled ", "miniled", "mini-led"]),
    ("console", 22, ["playstation", "xbox series", "nintendo switch", "ps5", "ps4"]),
    ("case", 75, ["gabinete", "pc case", "mid tower", "full tower", "airflow"]),
    ("keyboard", 60, ["teclado", "keyboard", "mechanical keyboard", "kumara", "keychron"]),
    ("mouse", 65, ["mouse", "g pro", "superlight", "deathadder"]),
    ("headset", 62, ["headset", "headphone", "earbuds", "fone de ouvido", "airpods"]),
    ("gamepad", 63, ["dualsense", "dualshock", "gamepad", "controle ", "xbox controller"]),
    ("router", 58, ["roteador", "router", "mesh wifi", "mesh wi-fi", "orbi", "deco"]),
    ("access_point", 59, ["access point", "unifi ap", "uap-", "outdoor ap"]),
    ("wifi_adapter", 68, ["adaptador wifi", "wifi adapter", "placa de rede", "pcie wifi"]),
    ("network_switch", 69, ["switch gerenciavel", "network switch", "poe switch", "gigabit switch"]),
    ("printer", 72, ["impressora", "printer", "multifuncional", "laserjet", "ecotank"]),
    ("scanner", 73, ["scanner", "scanjet"]),
    ("webcam", 74, ["webcam", "c920", "brio"]),
    ("microphone", 76, ["microfone", "microphone", "blue yeti", "sm7b"]),
    ("speaker", 77, ["soundbar", "caixa de som", "speaker", "sound bar"]),
    ("projector", 78, ["projetor", "projector", "epson home cinema"]),
    ("smartwatch", 28, ["apple watch", "smartwatch", "galaxy watch", "amazfit"]),
    ("camera", 80, ["camera ", "câmera", "mirrorless", "dslr", "gopro"]),
    ("lens", 81, ["lente ", "lens ", "f/1.", "f/2.", "mm f/"]),
    ("memory_card", 82, ["microsd", "sd card", "cfexpress", "cartao de memoria", "cartão sd"]),
    ("usb_drive", 83, ["pen drive", "pendrive", "flash drive", "usb drive"]),
    ("nas", 84, [" nas ", "synology", "qnap", "diskstation"]),
    ("ups", 85, ["nobreak", "no-break", " ups ", "sms station"]),
    ("power_strip", 86, ["estabilizador", "filtro de linha", "surge protector"]),
    ("charger", 87, ["carregador", "charger", "gan charger", "usb-c charger"]),
    ("laptop_charger", 88, ["fonte notebook", "laptop charger", "notebook adapter"]),
    ("dock", 89, ["dock ", "hub usb", "thunderbolt dock", "usb-c hub"]),
    ("cable", 90, ["cabo hdmi", "cabo displayport", "cabo usb", "thunderbolt cable", "cabo de rede", "patch cord"]),
    ("chair", 91, ["cadeira gamer", "cadeira escritorio", "office chair", "gaming chair"]),
    ("desk", 92, ["mesa gamer", "mesa escritorio", "standing desk", "escritório mesa"]),
    ("monitor_mount", 93, ["suporte monitor", "monitor arm", "monitor mount", "vesa mount"]),
]
NOTEBOOK_HINTS = (
    "notebook", "laptop", "ultrabook", "macbook", "rog strix g", "strix g16", "strix g15", "zephyrus", "ideapad", "thinkpad",
    "vivobook", "legion ", "nitro v",
)
VARIANT_FROM = {
    "smartphone": ("color", "storage"), "tablet": ("color", "storage", "connectivity"), "console": ("edition",),
}

# --- attributes -------------------------------------------------------------------------------

# label of a specification -> attribute
SPEC_LABELS = {
    "brand": ["brand", "marca", "manufacturer", "fabricante"],
    "model": ["model", "modelo", "model number", "mpn"],
    "color": ["color", "colour", "cor", "colore"],
    "storage": ["storage", "armazenamento", "almacenamiento", "capacidade", "capacidad", "built-in storage", "internal storage",
                "memoria interna", "internal memory", "ssd", "hdd", "disco"],
    "ram": ["ram", "memoria ram", "memory", "memoria", "system memory"],
    "vram": ["vram", "video memory", "memoria de video", "gddr"],
    "size": ["size", "tamanho", "tamaño", "volumen", "volume", "contenido", "conteudo"],
    "capacity": ["capacity", "capacidade", "capacidad", "contenido", "conteudo"],
    "screen_size": ["screen size", "screen", "display", "tela", "pantalla", "tamanho da tela", "tamaño de pantalla"],
    "voltage": ["voltage", "voltagem", "voltaje", "tensao"],
    "processor": ["processor", "processador", "procesador", "cpu", "chip", "chipset cpu"],
    "connectivity": ["connectivity", "conectividade", "network", "rede"],
    "memory_type": ["memory type", "tipo de memoria", "memoria", "ddr"],
    "frequency": ["frequency", "frequencia", "speed", "clock"],
    "cas_latency": ["cas", "cas latency", "latency", "cl", "latencia"],
    "module_count": ["modules", "module count", "modulos"],
    "module_capacity": ["module capacity", "capacidade por modulo", "por modulo"],
    "chipset": ["chipset"],
    "socket": ["socket", "soquete"],
    "wifi": ["wifi", "wi-fi", "wireless"],
    "cores": ["cores", "nucleos"],
    "threads": ["threads", "hilos", "threads cpu"],
    "gpu_model": ["gpu", "graphics", "placa de video", "video card"],
    "wattage": ["wattage", "potencia", "watts", "power"],
    "efficiency": ["efficiency", "certificacao", "80 plus"],
    "modularity": ["modularity", "modular", "modularidade"],
    "form_factor": ["form factor", "formato", "factor de forma"],
    "interface": ["interface", "protocol", "protocolo", "conexao"],
    "pcie_generation": ["pcie", "pci express", "pcie generation"],
    "refresh_rate": ["refresh rate", "taxa de atualizacao", "refresh"],
    "resolution": ["resolution", "resolucao"],
    "panel": ["panel", "painel", "panel type"],
    "cooler_type": ["cooler type", "tipo de cooler", "cooling"],
    "radiator_size": ["radiator", "radiador"],
    "overclocked": ["overclock", "oc"],
    "rpm": ["rpm", "rotacao"],
    "edition": ["edition", "edicao", "product line", "linha do produto", "cooler line"],
}
# sources of evidence, best first
EVIDENCE_ORDER = ("selected_variant", "specifications", "structured", "title", "url")
CATEGORY_PREFIXES = (
    "celular telefone smartphone notebook laptop ultrabook tablet perfume kit placa gpu placa-mae placa-mãe motherboard video "
    "vídeo fone headset console camera câmera camara tv monitor mouse teclado liquidificador air fryer depilador smartwatch "
    "relogio relógio cabo capa case fonte memoria memória processador cooler water ssd hdd nvme"
).split()
CONNECTORS = "de da do para com vídeo video".split()
MODEL_STOPS = (
    "sim dual esim 5g 4g wifi wi-fi unlocked libre edition edicao edición digital com with para de e and y oc rgb argb"
).split() + TITLE_COLORS
