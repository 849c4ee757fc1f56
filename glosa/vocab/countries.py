"""Country table: alpha-2 code, alpha-3 code and English short name of all 249 ISO 3166-1 entries.

``country_table`` accepts another table of the same shape.
"""

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
# ISO 3166-1 alpha-2, alpha-3, short name; in alpha-3 order: United Nations members
ISO_3166 = """
AF|AFG|Afghanistan
AO|AGO|Angola
AL|ALB|Albania
AD|AND|Andorra
AE|ARE|United Arab Emirates
AR|ARG|Argentina
AM|ARM|Armenia
AG|ATG|Antigua and Barbuda
AU|AUS|Australia
AT|AUT|Austria
AZ|AZE|Azerbaijan
BI|BDI|Burundi
BE|BEL|Belgium
BJ|BEN|Benin
BF|BFA|Burkina Faso
BD|BGD|Bangladesh
BG|BGR|Bulgaria
BH|BHR|Bahrain
BS|BHS|Bahamas
BA|BIH|Bosnia and Herzegovina
BY|BLR|Belarus
BZ|BLZ|Belize
BO|BOL|Bolivia, Plurinational State of
BR|BRA|Brazil
BB|BRB|Barbados
BN|BRN|Brunei Darussalam
BT|BTN|Bhutan
BW|BWA|Botswana
CF|CAF|Central African Republic
CA|CAN|Canada
CH|CHE|Switzerland
CL|CHL|Chile
CN|CHN|China
CI|CIV|Côte d'Ivoire
CM|CMR|Cameroon
CD|COD|Congo, The Democratic Republic of the
CG|COG|Congo
CO|COL|Colombia
KM|COM|Comoros
CV|CPV|Cabo Verde
CR|CRI|Costa Rica
CU|CUB|Cuba
CY|CYP|Cyprus
CZ|CZE|Czechia
DE|DEU|Germany
DJ|DJI|Djibouti
DM|DMA|Dominica
DK|DNK|Denmark
DO|DOM|Dominican Republic
DZ|DZA|Algeria
EC|ECU|Ecuador
EG|EGY|Egypt
ER|ERI|Eritrea
ES|ESP|Spain
EE|EST|Estonia
ET|ETH|Ethiopia
FI|FIN|Finland
FJ|FJI|Fiji
FR|FRA|France
FM|FSM|Micronesia, Federated States of
GA|GAB|Gabon
GB|GBR|United Kingdom
GE|GEO|Georgia
GH|GHA|Ghana
GN|GIN|Guinea
GM|GMB|Gambia
GW|GNB|Guinea-Bissau
GQ|GNQ|Equatorial Guinea
GR|GRC|Greece
GD|GRD|Grenada
GT|GTM|Guatemala
GY|GUY|Guyana
HN|HND|Honduras
HR|HRV|Croatia
HT|HTI|Haiti
HU|HUN|Hungary
ID|IDN|Indonesia
IN|IND|India
IE|IRL|Ireland
IR|IRN|Iran, Islamic Republic of
IQ|IRQ|Iraq
IS|ISL|Iceland
IL|ISR|Israel
IT|ITA|Italy
JM|JAM|Jamaica
JO|JOR|Jordan
JP|JPN|Japan
KZ|KAZ|Kazakhstan
KE|KEN|Kenya
KG|KGZ|Kyrgyzstan
KH|KHM|Cambodia
KI|KIR|Kiribati
KN|KNA|Saint Kitts and Nevis
KR|KOR|Korea, Republic of
KW|KWT|Kuwait
LA|LAO|Lao People's Democratic Republic
LB|LBN|Lebanon
LR|LBR|Liberia
LY|LBY|Libya
LC|LCA|Saint Lucia
LI|LIE|Liechtenstein
LK|LKA|Sri Lanka
LS|LSO|Lesotho
LT|LTU|Lithuania
LU|LUX|Luxembourg
LV|LVA|Latvia
MA|MAR|Morocco
MC|MCO|Monaco
MD|MDA|Moldova, Republic of
MG|MDG|Madagascar
MV|MDV|Maldives
MX|MEX|Mexico
MH|MHL|Marshall Islands
MK|MKD|North Macedonia
ML|MLI|Mali
MT|MLT|Malta
MM|MMR|Myanmar
ME|MNE|Montenegro
MN|MNG|Mongolia
MZ|MOZ|Mozambique
MR|MRT|Mauritania
MU|MUS|Mauritius
MW|MWI|Malawi
MY|MYS|Malaysia
NA|NAM|Namibia
NE|NER|Niger
NG|NGA|Nigeria
NI|NIC|Nicaragua
NL|NLD|Netherlands
NO|NOR|Norway
NP|NPL|Nepal
NR|NRU|Nauru
NZ|NZL|New Zealand
OM|OMN|Oman
PK|PAK|Pakistan
PA|PAN|Panama
PE|PER|Peru
PH|PHL|Philippines
PW|PLW|Palau
PG|PNG|Papua New Guinea
PL|POL|Poland
KP|PRK|Korea, Democratic People's Republic of
PT|PRT|Portugal
PY|PRY|Paraguay
QA|QAT|Qatar
RO|ROU|Romania
RU|RUS|Russian Federation
RW|RWA|Rwanda
SA|SAU|Saudi Arabia
SD|SDN|Sudan
SN|SEN|Senegal
SG|SGP|Singapore
SB|SLB|Solomon Islands
SL|SLE|Sierra Leone
SV|SLV|El Salvador
SM|SMR|San Marino
SO|SOM|Somalia
RS|SRB|Serbia
SS|SSD|South Sudan
ST|STP|Sao Tome and Principe
SR|SUR|Suriname
SK|SVK|Slovakia
SI|SVN|Slovenia
SE|SWE|Sweden
SZ|SWZ|Eswatini
SC|SYC|Seychelles
SY|SYR|Syrian Arab Republic
TD|TCD|Chad
TG|TGO|Togo
TH|THA|Thailand
TJ|TJK|Tajikistan
TM|TKM|Turkmenistan
TL|TLS|Timor-Leste
TO|TON|Tonga
TT|TTO|Trinidad and Tobago
TN|TUN|Tunisia
TR|TUR|Turkey
TV|TUV|Tuvalu
TZ|TZA|Tanzania, United Republic of
UG|UGA|Uganda
UA|UKR|Ukraine
UY|URY|Uruguay
US|USA|United States
UZ|UZB|Uzbekistan
VC|VCT|Saint Vincent and the Grenadines
VE|VEN|Venezuela, Bolivarian Republic of
VN|VNM|Viet Nam
VU|VUT|Vanuatu
WS|WSM|Samoa
YE|YEM|Yemen
ZA|ZAF|South Africa
ZM|ZMB|Zambia
ZW|ZWE|Zimbabwe
"""
# the other entries of ISO 3166-1: territories and states outside the United Nations
ISO_3166_OTHERS = """
AW|ABW|Aruba
AI|AIA|Anguilla
AX|ALA|Åland Islands
AS|ASM|American Samoa
AQ|ATA|Antarctica
TF|ATF|French Southern Territories
BQ|BES|Bonaire, Sint Eustatius and Saba
BL|BLM|Saint Barthélemy
BM|BMU|Bermuda
BV|BVT|Bouvet Island
CC|CCK|Cocos (Keeling) Islands
CK|COK|Cook Islands
CW|CUW|Curaçao
CX|CXR|Christmas Island
KY|CYM|Cayman Islands
EH|ESH|Western Sahara
FK|FLK|Falkland Islands (Malvinas)
FO|FRO|Faroe Islands
GG|GGY|Guernsey
GI|GIB|Gibraltar
GP|GLP|Guadeloupe
GL|GRL|Greenland
GF|GUF|French Guiana
GU|GUM|Guam
HK|HKG|Hong Kong
HM|HMD|Heard Island and McDonald Islands
IM|IMN|Isle of Man
IO|IOT|British Indian Ocean Territory
JE|JEY|Jersey
MO|MAC|Macao
MF|MAF|Saint Martin (French part)
MP|MNP|Northern Mariana Islands
MS|MSR|Montserrat
MQ|MTQ|Martinique
YT|MYT|Mayotte
NC|NCL|New Caledonia
NF|NFK|Norfolk Island
NU|NIU|Niue
PN|PCN|Pitcairn
PR|PRI|Puerto Rico
PS|PSE|Palestine, State of
PF|PYF|French Polynesia
RE|REU|Réunion
GS|SGS|South Georgia and the South Sandwich Islands
SH|SHN|Saint Helena, Ascension and Tristan da Cunha
SJ|SJM|Svalbard and Jan Mayen
PM|SPM|Saint Pierre and Miquelon
SX|SXM|Sint Maarten (Dutch part)
TC|TCA|Turks and Caicos Islands
TK|TKL|Tokelau
TW|TWN|Taiwan, Province of China
UM|UMI|United States Minor Outlying Islands
VA|VAT|Holy See (Vatican City State)
VG|VGB|Virgin Islands, British
VI|VIR|Virgin Islands, U.S.
WF|WLF|Wallis and Futuna
"""
# ------------------------------------------------------------ end fixed values


def country_rows() -> list[tuple[str, str, str]]:
    """(alpha2, alpha3, name), members first, each part in table order."""
    return [tuple(line.split("|")) for part in (ISO_3166, ISO_3166_OTHERS) for line in part.strip().splitlines()]


def flag_of(alpha2: str) -> str:
    """The two regional indicator symbols of an alpha-2 code."""
    return "".join(chr(0x1F1E6 + ord(c) - ord("A")) for c in alpha2)


def country_table(spark: SparkSession, rows=None) -> DataFrame:
    """Country dimension: alpha2, alpha3, country, flag."""
    rows = [(a2, a3, name, flag_of(a2)) for a2, a3, name in (rows or country_rows())]
    return spark.createDataFrame(rows, "alpha2 string, alpha3 string, country string, flag string")
