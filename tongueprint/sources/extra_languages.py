"""ISO 639-3 names of languages that the ICU data shipped with Spark does not list."""

# ISO 639-3 code and English name, in code order.
EXTRA_LANGUAGES = """
abb Bankon
acf Saint Lucian Creole French
ajg Aja (Benin)
apd Sudanese Arabic
arb Standard Arabic
azj North Azerbaijani
bag Tuki
bba Baatonum
bbl Bats
bce Bamenyam
bci Baoulé
bcl Central Bikol
beb Bebele
bft Balti
bgp Eastern Balochi
bkh Bakoko
bnm Batanga
bnn Bunun
bri Mokpwe
bsh Kati
bsk Burushaski
btv Bateri
bxk Bukusu
cjk Chokwe
cmn Mandarin Chinese
cnh Hakha Chin
cpy South Ucayali Ashéninka
cut Teutila Cuicatec
cux Tepeuxila Cuicatec
dag Dagbani
dmk Domaaki
dml Dameli
dru Rukai
ebr Ebrié
eko Koti
esu Central Yupik
eto Eton (Cameroon)
ext Extremaduran
fmp Fe'fe'
fub Adamawa Fulfulde
fue Borgu Fulfulde
fuv Nigerian Fulfulde
gaz West Central Oromo
gcf Guadeloupean Creole French
gcr Guianese Creole French
gej Gen
ggg Gurgula
gid Gidar
gig Goaria
giz South Giziga
gjk Kachi Koli
gju Gujari
gom Goan Konkani
gug Paraguayan Guaraní
guw Gun
gwc Gawri
gwt Gawar-Bati
gya Northwest Gbaya
haz Hazaragi
hbo Ancient Hebrew
hch Huichol
hem Hemba
hno Northern Hindko
hux Nüpode Huitoto
jqr Jaqaru
kcn Nubi
kdh Tem
khw Khowar
kls Kalasha
kmr Northern Kurdish
koo Konzo
kvx Parkari Koli
kxp Wadiyara Koli
led Lendu
lij Ligurian
lke Kenyi
lrk Loarki
lss Lasi
ltg Latgalian
lth Thur
luo Luo (Kenya and Tanzania)
lvs Standard Latvian
mau Huautla Mazatec
mbo Mbo (Cameroon)
mcf Matsés
mcn Masana
mcx Mpiemo
mdd Mbum
meh Southwestern Tlaxiaco Mixtec
mgg Mpumpong
mhk Mungaka
mhr Eastern Mari
mki Dhatki
mmc Michoacán Mazahua
mrj Western Mari
mse Musey
mug Musgu
mve Marwari (Pakistan)
mvy Indus Kohistani
mxu Mada (Cameroon)
nan Min Nan Chinese
ncx Central Puebla Nahuatl
nhi Zacatlán-Ahuacatlán-Tepetzintla Nahuatl
nla Ngombale
nlv Orizaba Nahuatl
nmz Nawdm
nyu Nyungwe
odk Od
oru Ormuri
ory Odia (individual language)
pcm Nigerian Pidgin
phl Phalura
phr Pahari-Potwari
plk Kohistani Shina
pne Western Penan
prq Ashéninka Perené
pua Western Highland Purepecha
pwn Paiwan
qup Southern Pastaza Quechua
qur Yanahuanca Pasco Quechua
qus Santiago del Estero Quichua
qux Yauyos Quechua
quy Ayacucho Quechua
qva Ambo-Pasco Quechua
qvi Imbabura Highland Quichua
qvj Loja Highland Quichua
qvl Cajatambo North Lima Quechua
qwa Corongo Ancash Quechua
qws Sihuas Ancash Quechua
qxa Chiquián Ancash Quechua
qxp Puno Quechua
qxt Santa Ana de Tusi Pasco Quechua
qxu Arequipa-La Unión Quechua
qxw Jauja Wanca Quechua
rcf Réunion Creole French
ruc Ruuli
rwm Amba (Uganda)
sbn Sindhi Bhil
scl Shina
sei Seri
skr Saraiki
ssi Sansi
sva Svan
swh Swahili (individual language)
szy Sakizaya
tar Central Tarahumara
tay Atayal
tob Toba
tok Toki Pona
top Papantla Totonac
trw Torwali
ttj Tooro
tui Tupuri
tvu Tunen
udl Wuzlam
ukv Kuku
ush Ushojo
uzs Southern Uzbek
var Huarijio
vec Venetian
wbl Wakhi
wes Cameroon Pidgin
wuu Wu Chinese
xhe Khetrani
xka Kalkoti
xmf Mingrelian
yaq Yaqui
ydg Yidgha
zgh Standard Moroccan Tamazight
zoc Copainalá Zoque
zsm Standard Malay
"""
