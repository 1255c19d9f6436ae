"""Labelled lines from which the structural profiles are fitted, and prose by which languages are known without a table.

Every line was written for this and carries its kind. Lines of prose also carry their language.
"""

TABLE = r"""
| name | size | owner |
| --- | :---: | ---: |
| river gauge | 4.2 | n/a |
| mill |  | 2019-04-02 | open | 77 |
| first heading | second heading | third heading | fourth heading |
| 12 | 0.5 | 1999 | 3 |
|---|---|
|-
| north || 14 || 3.5
! Town !! People !! Since
{| class="wikitable"
|}
+-------+-------+-------+
+======+======+
| old bridge           | 17                   | closed               |
<tr><td>oak</td><td>12</td><td>n/a</td></tr>
<tr><th>tree</th><th>height</th></tr>
<tr><td></td><td>0.25</td><td></td><td>2020-01-05</td></tr>
<table>
</table>
oak	12	n/a	2020-01-05
first heading	second heading	third heading
	0.5	17		closed
oak,12,n/a,2020-01-05
"wide river","old bridge",third heading,fourth heading
oak,,,0.5,"17"
12,0.5,1999,,3
oak;12;n/a;2020-01-05
"wide river";"old bridge";third heading
;;0.5;;
oak                     12                      n/a
wide river              old bridge              third heading
0.5                     17                      2020-01-05
---------------------   ---------------------   ---------------------
大型河流 | 12 | 旧的桥
| 桥 | 12 | n/a |
12 & 0.5 & oak \\
""".strip("\n").split("\n")

LIST = r"""
- river gauge
- Old Bridge
- open the gate
* wide river
    + second bank
* [ ] paint the door
- [x] count the boats
• Northern Mill
• 旧的桥
– another one
1. first oak
2) second oak
14. the third oak of the row
a) reeds
(b) willows
iv. the fourth
12. Mill 4
Northern Mill
Old bridge
river gauge
Second bank, lower part
Recent boats and barges
Oak No. 5
Gauge 12
Boat 7
Bridge 40
Die Mühle 3
depth: 12 metres
owner: Anna Holm
status: closed since spring
<li>old bridge</li>
<ul>
</ol>
Chapter one ........ 17
bridge … 12, 48
oak … 3
gate, 4, 18, 212
# Boats
## The lower part
; reed
: a tall grass
大型河流
旧的桥
[ ] sweep the yard
* Boats of the north (3)
- #12 mended
Mill Street 4
""".strip("\n").split("\n")

JUNK = r"""
xk qwrt pls zzv bntr wkd
wqrtpsdf
dfgh jklq wrtz pscvb
asdkj hqwe lkjzx mnbqw eoiru
fkgjw;ertl qpwo;slkd jfhg;zmxn
tmlq..
xvb
bcdfg  hjklm  npqrst
a9 3f 00 c4 d1 7e 2b 88 19 fe
00 00 00 00 1f 8b 08 00 5a
QmFzZTY0IGlzIGEgZ3JvdXAgb2YgZW5jb2Rpbmcgc2NoZW1lcw==
iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk
MIIBIjANBgkqhkiG9w0BAQEFAAOCAQ8AMIIBCgKCAQEA7tqZ
�������������������������
□■ ??�■□ �□ ■■?? □
?? □□ ■ ??□ ■�
~^%& @#$* +=<> {}[] |\_ /?!;
]]>>{{#@!! ~~^^ ||&& %%$$
Tâ€™hÃ© rÃ©pÃ´rt Ã¢t nâ€œoon
ÂmÂÂ©ÂulÂÂin Ââ€eaÂâ€u ÂÂeÂÂpont Ã©Ââ€r ÂÂ€vÂ iÃÂeÂ. ÃÂaÂâ€ƒrbÂ re
Ãâ€oÂ©ÂƒÂr ÂÂ€m™â€ÃÂlinÂ©Ââ€ ÃÂdÂâ€ƒÂe
Ã¼ber dÃ¤s â€žHausâ€œ Ã¶ffnÃ©t
Â©Ãƒâ€šÂ Ã‚Â¿Â½ Ã¯Â»Â¿
Th3 r!v3r w`s w1de ,nd c0ld th|s y~ar
0ur br|dge .s c!osed s,nce th3 f1ood
n~w b0ats c`me d;wn t^e r1ver
0l~ m!ll| ., wa^er`s b|r~e; `n the d0.k |s n~t  o!en'
`|he  r~v'r ^s|de 0, a1d .he |br!dge~ n0t| cl0s`d 'or ,t|. 1|t
ÃƒÂ©tÃ©Ââ€™Â dÃ©Â cÃƒÂ´tÃ©Ââ€œ aÃ™â€Â nÂ©oÃÂ€r
lalalalalalalalalalalalalalalalalala
@@@@@@@@@@@@@@@@@@@@@@
=-=-=-=-=-=-=-=-=-=-=-=-=
ohwjj ufel qks wlt iwr klai eks dhh otj jqaa
ghwpr. tlkzn. wrtsd. bnmkl.
""".strip("\n").split("\n")

PROSE = {
    "en": r"""
The river was wide and cold that year.
Nobody knew why the old bridge had been closed since the spring.
She said that it would be open again before the end of May, but he did not believe her.
Boats came down from the north every morning.
It rained.
"It is open,"
said the miller Anna Holm.
In 1920 about 40 of the houses by the mill were lost.
"We have to go," he said, "and we will not be back."
Count the boats.
The gate (which was built in 1871) is now owned by the town, and its keys are with the mayor.
Anna Holm and Peter Wald met at the mill of Marten Lund in Oslo.
See [the map](a/b.md) for the way, or `ask` at the **mill**.
After the flood, farmers, millers, and fishers rebuilt walls, roads, and gates
""",
    "de": r"""
Der Fluss war in diesem Jahr breit und kalt.
Niemand wusste, warum die alte Brücke seit dem Frühling geschlossen war.
Sie sagte, dass sie vor Ende Mai wieder offen sei, aber er glaubte ihr nicht.
Es regnete.
Im Jahr 1920 wurden etwa 40 der Häuser an der Mühle zerstört.
Jeden Morgen kamen Boote aus dem Norden.
""",
    "fr": r"""
La rivière était large et froide cette année.
Personne ne savait pourquoi le vieux pont était fermé depuis le printemps.
Elle a dit qu'il serait ouvert avant la fin de mai, mais il ne la croyait pas.
Il pleuvait.
En 1920, environ 40 des maisons du moulin ont été perdues.
Des bateaux venaient du nord chaque matin.
""",
    "es": r"""
El río estaba ancho y frío ese año.
Nadie sabía por qué el viejo puente estaba cerrado desde la primavera.
Ella dijo que estaría abierto antes de fin de mayo, pero él no le creyó.
Llovía.
En 1920 se perdieron unas 40 de las casas del molino.
Cada mañana llegaban barcos del norte.
""",
    "it": r"""
Il fiume era largo e freddo quell'anno.
Nessuno sapeva perché il vecchio ponte fosse chiuso dalla primavera.
Ha detto che sarebbe stato aperto prima della fine di maggio, ma lui non le ha creduto.
""",
    "pt": r"""
O rio estava largo e frio naquele ano.
Ninguém sabia por que a velha ponte estava fechada desde a primavera.
Ela disse que estaria aberta antes do fim de maio, mas ele não acreditou.
""",
    "ru": r"""
Река в том году была широкой и холодной.
Никто не знал, почему старый мост закрыт с весны.
Она сказала, что его откроют до конца мая, но он ей не поверил.
""",
    "zh": r"""
那一年河又宽又冷。
（旧的桥还没有开放。）
下雨了。
没有人知道为什么旧桥从春天起就关闭了。
她说桥会在五月底之前重新开放，但是他不相信。
""",
    "ja": r"""
その年、川は広くて冷たかった。
古い橋がなぜ春から閉まっているのか、誰も知りませんでした。
五月の終わりまでに開くと彼女は言いましたが、彼は信じませんでした。
""",
    "el": r"""
Το ποτάμι ήταν πλατύ και κρύο εκείνη τη χρονιά.
Κανείς δεν ήξερε γιατί η παλιά γέφυρα ήταν κλειστή από την άνοιξη.
""",
    "ar": r"""
كان النهر واسعا وباردا في ذلك العام.
لم يعرف أحد لماذا أغلق الجسر القديم منذ الربيع.
""",
    "hi": r"""
उस साल नदी चौड़ी और ठंडी थी।
कोई नहीं जानता था कि पुराना पुल वसंत से क्यों बंद है।
""",
    "th": r"""
ปีนั้นแม่น้ำกว้างและเย็น
ไม่มีใครรู้ว่าทำไมสะพานเก่าจึงปิดตั้งแต่ฤดูใบไม้ผลิ
""",
    "ko": r"""
그 해에 강은 넓고 차가웠다.
왜 오래된 다리가 봄부터 닫혀 있는지 아무도 몰랐다.
""",
}
