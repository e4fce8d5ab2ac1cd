"""Seed dictionaries of the stopping-power vocabulary. Users bring their own tables of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ELECTRON, LAST_MATERIAL_Z = 1001, 98

# fixed values: atomic number, symbol, name, default mass number
ELEMENTS = """
1 H Hydrogen 1
2 He Helium 4
3 Li Lithium 7
4 Be Beryllium 9
5 B Boron 11
6 C Carbon 12
7 N Nitrogen 14
8 O Oxygen 16
9 F Fluorine 19
10 Ne Neon 20
11 Na Sodium 23
12 Mg Magnesium 24
13 Al Aluminium 27
14 Si Silicon 28
15 P Phosphorus 31
16 S Sulfur 32
17 Cl Chlorine 35
18 Ar Argon 40
19 K Potassium 39
20 Ca Calcium 40
21 Sc Scandium 45
22 Ti Titanium 48
23 V Vanadium 51
24 Cr Chromium 52
25 Mn Manganese 55
26 Fe Iron 56
27 Co Cobalt 59
28 Ni Nickel 58
29 Cu Copper 63
30 Zn Zinc 64
31 Ga Gallium 69
32 Ge Germanium 74
33 As Arsenic 75
34 Se Selenium 80
35 Br Bromine 79
36 Kr Krypton 84
37 Rb Rubidium 85
38 Sr Strontium 88
39 Y Yttrium 89
40 Zr Zirconium 90
41 Nb Niobium 93
42 Mo Molybdenum 98
43 Tc Technetium 98
44 Ru Ruthenium 102
45 Rh Rhodium 103
46 Pd Palladium 106
47 Ag Silver 107
48 Cd Cadmium 114
49 In Indium 115
50 Sn Tin 120
51 Sb Antimony 121
52 Te Tellurium 130
53 I Iodine 127
54 Xe Xenon 132
55 Cs Caesium 133
56 Ba Barium 138
57 La Lanthanum 139
58 Ce Cerium 140
59 Pr Praseodymium 141
60 Nd Neodymium 142
61 Pm Promethium 145
62 Sm Samarium 152
63 Eu Europium 153
64 Gd Gadolinium 158
65 Tb Terbium 159
66 Dy Dysprosium 164
67 Ho Holmium 165
68 Er Erbium 166
69 Tm Thulium 169
70 Yb Ytterbium 174
71 Lu Lutetium 175
72 Hf Hafnium 180
73 Ta Tantalum 181
74 W Tungsten 184
75 Re Rhenium 187
76 Os Osmium 192
77 Ir Iridium 193
78 Pt Platinum 195
79 Au Gold 197
80 Hg Mercury 202
81 Tl Thallium 205
82 Pb Lead 208
83 Bi Bismuth 209
84 Po Polonium 209
85 At Astatine 210
86 Rn Radon 222
87 Fr Francium 223
88 Ra Radium 226
89 Ac Actinium 227
90 Th Thorium 232
91 Pa Protactinium 231
92 U Uranium 238
93 Np Neptunium 237
94 Pu Plutonium 244
95 Am Americium 243
96 Cm Curium 247
97 Bk Berkelium 247
98 Cf Californium 251
99 Es Einsteinium 252
100 Fm Fermium 257
101 Md Mendelevium 258
102 No Nobelium 259
103 Lr Lawrencium 262
104 Rf Rutherfordium 267
105 Db Dubnium 268
106 Sg Seaborgium 269
107 Bh Bohrium 270
108 Hs Hassium 269
109 Mt Meitnerium 278
110 Ds Darmstadtium 281
111 Rg Roentgenium 282
112 Cn Copernicium 285
113 Nh Nihonium 286
114 Fl Flerovium 289
115 Mc Moscovium 290
116 Lv Livermorium 293
117 Ts Tennessine 294
118 Og Oganesson 294
"""

# fixed values: names that also stand for an element
ELEMENT_VARIANTS = [("aluminum", 13), ("sulphur", 16), ("cesium", 55), ("wolfram", 74)]

# fixed values: material number and name of compounds
COMPOUNDS = """
99 A-150 Tissue-Equivalent Plastic
103 Adipose Tissue (ICRP)
104 Air (dry, near sea level)
106 Aluminum Oxide
113 Barium Fluoride
114 Barium Sulfate
116 Beryllium Oxide
117 Bismuth Germanium Oxide
118 Blood (ICRP)
119 Bone, Compact (ICRU)
120 Bone, Cortical (ICRP)
121 Boron Carbide
122 Boron Oxide
123 Brain (ICRP)
125 N-Butyl Alcohol
127 Cadmium Telluride
128 Cadmium Tungstate
129 Calcium Carbonate
130 Calcium Fluoride
131 Calcium Oxide
132 Calcium Sulfate
133 Calcium Tungstate
134 Carbon Dioxide
135 Carbon Tetrachloride
136 Cellulose Acetate (Cellophane)
137 Cellulose Acetate Butyrate
138 Cellulose Nitrate
139 Ceric Sulfate Dosimeter Solution
140 Cesium Fluoride
141 Cesium Iodide
142 Chlorobenzene
143 Chloroform
144 Concrete (Portland)
145 Cyclohexane
146 Dichlorobenzene
147 Dichlorodiethyl Ether
148 Dichloroethane
149 Diethyl Ether
150 N,N-Dimethylformamide
151 Dimethyl Sulfoxide
152 Ethane
153 Ethyl Alcohol
154 Ethyl Cellulose
155 Ethylene
156 Eye Lens (ICRP)
157 Ferric Oxide
159 Ferrous Oxide
160 Ferrous Sulfate Dosimeter Solution
161 Freon-12
162 Freon-12B2
163 Freon-13
164 Freon-13B1
165 Freon-13I1
166 Gadolinium Oxysulfide
167 Gallium Arsenide
168 Gel in Photographic Emulsion
169 Glass (Pyrex)
170 Glass (Lead)
171 Glass (Plate)
172 Glucose
174 Glycerol
176 Gypsum (Plaster of Paris)
177 N-Heptane
178 N-Hexane
179 Kapton Polyimide Film
180 Lanthanum Oxybromide
181 Lanthanum Oxysulfide
182 Lead Oxide
183 Lithium Amide
184 Lithium Carbonate
185 Lithium Fluoride
186 Lithium Hydride
187 Lithium Iodide
188 Lithium Oxide
189 Lithium Tetraborate
190 Lung (ICRP)
192 Magnesium Carbonate
193 Magnesium Fluoride
194 Magnesium Oxide
195 Magnesium Tetraborate
196 Mercuric Iodide
200 MS20 Tissue Substitute
201 Muscle, Skeletal
202 Muscle, Striated
203 Muscle-Equivalent Liquid (with sucrose)
204 Muscle-Equivalent Liquid (without sucrose)
208 Nylon (DuPont Elvamide 8062)
209 Nylon Type 6 and 6/6
210 Nylon Type 6-10
211 Nylon Type 11 (Rilsan)
212 Octane (liquid)
213 Paraffin Wax
214 N-Pentane
215 Photographic Emulsion
216 Plastic Scintillator (vinyltoluene-based)
217 Plutonium Dioxide
218 Polyacrylonitrile
219 Polycarbonate (Makrolon/Lexan)
220 Polychlorostyrene
221 Polyethylene
222 Mylar (PET)
223 PMMA (Plexiglass)
224 Polyoxymethylene
225 Polypropylene
226 Polystyrene
227 Polytetrafluoroethylene (Teflon)
228 Polytrifluorochloroethylene
229 Polyvinyl Acetate
230 Polyvinyl Alcohol
231 Polyvinyl Butyral
232 Polyvinyl Chloride (PVC)
233 Saran
234 Polyvinylidene Fluoride
235 Polyvinylpyrrolidone
236 Potassium Iodide
237 Potassium Oxide
239 Propane (liquid)
240 N-Propyl Alcohol
242 Rubber (butyl)
243 Rubber (natural)
244 Rubber (neoprene)
245 Silicon Dioxide
246 Silver Bromide
247 Silver Chloride
248 Silver Halides in Photographic Emulsion
249 Silver Iodide
250 Skin (ICRP)
251 Sodium Carbonate
252 Sodium Iodide
253 Sodium Monoxide
254 Sodium Nitrate
258 Testes (ICRP)
259 Tetrachloroethylene
260 Thallium Chloride
261 Tissue, Soft (ICRP)
262 Tissue, Soft (ICRU four-component)
263 Tissue-Equivalent Gas (methane-based)
264 Tissue-Equivalent Gas (propane-based)
265 Titanium Dioxide
267 Trichloroethylene
268 Triethyl Phosphate
269 Tungsten Hexafluoride
270 Uranium Dicarbide
271 Uranium Monocarbide
272 Uranium Oxide
275 Viton Fluoroelastomer
276 Water (liquid)
277 Water Vapor
906 Graphite
"""

# fixed values: other names of materials, by material number
MATERIAL_NAMES = {
    276: ["water", "liquid water", "h2o"],
    277: ["water vapor", "water vapour", "steam"],
    104: ["air"],
    223: ["pmma", "lucite", "perspex", "plexiglas", "plexiglass", "acrylic"],
    227: ["teflon", "ptfe"],
    222: ["mylar", "pet", "polyester"],
    179: ["kapton"],
    219: ["lexan", "makrolon", "polycarbonate"],
    232: ["pvc"],
    221: ["polyethylene"],
    226: ["polystyrene"],
    225: ["polypropylene"],
    906: ["graphite"],
    169: ["glass", "pyrex"],
    245: ["quartz", "silica", "fused silica", "silicon dioxide"],
    106: ["alumina", "sapphire", "aluminium oxide", "aluminum oxide"],
    261: ["tissue", "soft tissue"],
    201: ["muscle", "muscle tissue", "skeletal muscle"],
    202: ["striated muscle"],
    103: ["adipose tissue", "adipose", "fat"],
    190: ["lung", "lung tissue"],
    120: ["bone", "cortical bone"],
    119: ["compact bone"],
    123: ["brain"],
    250: ["skin"],
    118: ["blood"],
    99: ["a150", "a 150"],
    144: ["concrete"],
    252: ["nai", "sodium iodide"],
    141: ["csi"],
    185: ["lif"],
    213: ["paraffin"],
}

# fixed values: particles whose isotope the name settles; particle number, mass number, names
PARTICLE_NAMES = [
    (1, 1, ["proton", "protons", "p", "p+", "1H"]),
    (1, 2, ["deuteron", "deuterons", "d", "2H", "deuterium"]),
    (1, 3, ["triton", "tritons", "t", "3H", "tritium"]),
    (2, 4, ["alpha", "alphas", "alpha particle", "alpha particles", "α", "4He"]),
    (2, 3, ["helion", "3He"]),
    (1001, 0, ["electron", "electrons", "e-", "e⁻", "beta", "β", "beta minus"]),
]

# fixed values: folded program name and program number
PROGRAM_KEYS = [("ASTAR", 1), ("PSTAR", 2), ("ESTAR", 3), ("MSTAR", 4), ("ICRU73", 6), ("ICRU49", 7), ("ICRU", 7), ("DEFAULT", 100), ("BETHE", 100), ("BETHEEXT", 101), ("LIBDEDX", 100)]

# fixed values: program number and shown name
PROGRAM_NAMES = [(1, "ASTAR"), (2, "PSTAR"), (3, "ESTAR"), (4, "MSTAR"), (6, "ICRU73"), (7, "ICRU49"), (100, "Bethe"), (101, "Bethe-ext")]

# fixed values: particle number (0: any other), programs in order of preference
PROGRAMS_OF = {1: [2, 7, 100], 2: [1, 7, 100], 0: [4, 6, 100]}


def elements(spark: SparkSession) -> DataFrame:
    rows = [(int(z), s, n, int(a)) for z, s, n, a in (x.split() for x in ELEMENTS.strip().splitlines())]
    return spark.createDataFrame(rows, "z int, symbol string, name string, default_mass_number int")


def element_variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELEMENT_VARIANTS, "variant string, z int")


def compounds(spark: SparkSession) -> DataFrame:
    rows = [(int(i), n) for i, n in (x.split(" ", 1) for x in COMPOUNDS.strip().splitlines())]
    return spark.createDataFrame(rows, "id int, name string")


def material_names(spark: SparkSession) -> DataFrame:
    """alias, entity_id, seq in the order given."""
    pairs = [(n, i) for i, names in MATERIAL_NAMES.items() for n in names]
    return spark.createDataFrame([(n, i, k) for k, (n, i) in enumerate(pairs)], "alias string, entity_id int, seq long")


def particle_names(spark: SparkSession) -> DataFrame:
    """alias, entity_id, mass_number, seq in the order given."""
    rows = [(n, i, a) for i, a, names in PARTICLE_NAMES for n in names]
    return spark.createDataFrame([(n, i, a, k) for k, (n, i, a) in enumerate(rows)], "alias string, entity_id int, mass_number int, seq long")


def program_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROGRAM_KEYS, "program_key string, program_id int")


def program_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROGRAM_NAMES, "program_id int, program_name string")


def programs_of(spark: SparkSession) -> DataFrame:
    """for_particle (0: any other), pos, program_id; the first is the automatic one."""
    rows = [(p, k, i) for p, own in PROGRAMS_OF.items() for k, i in enumerate(own)]
    return spark.createDataFrame(rows, "for_particle int, pos int, program_id int")
