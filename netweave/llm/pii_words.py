"""Word lists of the generator of labelled texts, written without the corpus.

TRAINED is what the tagger learns from, HELD what it is measured on; they share no name, street, domain or phrase, and a
test holds that neither follows the corpus. Phrases come as ``before`` and ``after`` a slot and are combined freely, so
that a slot meets many neighbours. Slots of plain sentences: t town, d weekday, n number, x technical text, h handle,
w street without number, c capitalised words that are no person, g given name of a thing.
"""

from __future__ import annotations

# Word lists.
TRAINED = {
    "given": (
        "Abigail Adrian Agnes Albert Alina Amara Andrei Anton Arthur Astrid Aurelio Beatriz Benedict Birgit Boris Camille Carlos Cecilia Charlotte Cornelia Cyril Damian Daniela Dieter Dmitri Edith Eduardo Emeka "
        "Emil Esther Fatima Fernanda Florian Frieda Gabriel Georg Giulia Gordon Hannah Hassan Heinrich Helena Ibrahim Irene Isaac Ivana Jakob Janet Joaquin Joseph Judith Kenneth Khalid Kirsten Laurent Leonie "
        "Magnus Marcel Marta Mateo Matilda Michele Monika Natasha Niklas Olga Otto Pascal Philippa Quentin Ralf Renata Rosalind Samir Sigrid Silvio Stella Tamara Tobias Ursula Valerie Viktor Walter Xavier Yusuf Zoe "
        "Aisha Bjorn Chloe Dagmar Eugenio Finn Gisela Harold Ines Jorge Kaori Lorenzo Mina Noah Ottilie Piotr Raul Svea Thierry Una Vanessa Wilhelm Ximena Yannick Zelda Hugo Meike Oskar "
        "Alfonso Alma Ambrose Anouk Arnold Barnaby Basil Berta Blanca Bruno Celeste Claude Cordula Cosimo Cuthbert Desmond Dolores Dominik Edgar Egon Elfriede Elvira Enrique Ernst Eva Ferdinand Flora Gaston Geraldine "
        "Gerhard Gilbert Gottfried Graham Gunther Hedwig Horst Humbert Imelda Isabel Jasper Josef Julius Kamila Klaus Lars Leopold Lothar Louise Lukas Manfred Marguerite Mercedes Miriam Mohamed Nora Norbert Octavia Olaf "
        "Patricia Percival Pilar Ramona Reinhold Rosa Ruth Sandrine Santiago Siegfried Simone Sofia Steffen Tatjana Teresa Timothy Vera Vincent Waltraud Yvonne"
    ).split(),
    "family": (
        "Abernathy Achterberg Almeida Andersson Bachmann Baranova Beaumont Bergstrom Blackwood Bonnard Cabrera Carmichael Chaudhry Cortese Crawford Dahlgren Delacroix Dombrowski Eberhardt Escobar Fairbanks Ferreira "
        "Fitzgerald Fontaine Gallagher Garnier Goldberg Grunwald Gutierrez Hargreaves Hernandez Hoffmann Hutchinson Iglesias Jankowski Johansson Karlsson Kaufmann Kovalenko Lachance Lombardi MacGregor Maldonado "
        "Mbeki Mensah Moreau Nakamura Navarro Nikolaidis Novotny Oliveira Papadakis Pellegrini Quintero Rasmussen Rosenthal Schneider Stevenson Takahashi Thibault Ungerer Vandenberg Villanueva Whitfield Yamamoto "
        "Zimmermann Adeyemi Barbieri Cheng Dvorak Eriksen Fuchs Greco Hussain Ivanov Jensen Keller Larsson Meyer Nguyen O'Brien Pereira Reyes Silva Torres Urban Vogel Weber Young Zhao Baker Cooper Fisher Miller Taylor "
        "Aguirre Altmann Ballard Bellini Birnbaum Boucher Braunfels Callahan Chevalier Cisneros Cunningham Dietrich Durand Ellsworth Espinoza Faulkner Fournier Gasparini Haldane Heidegger Ibsen Jaworski Kellermann Lefevre "
        "Lindgren Machado Marchand Montgomery Nordstrom Obermeier Pacheco Perrault Rautenberg Richelieu Salvatore Schaefer Sheffield Steinbrenner Sundqvist Thackeray Valdez Vermeulen Wainwright Weissmann Winterbottom Zapata"
    ).split(),
    "given_ru": "Алексей Борис Вера Галина Дарья Евгений Жанна Зоя Ирина Кирилл Лариса Максим Никита Оксана Роман Светлана Татьяна Ульяна Фёдор Юрий Яна Артём Валентина Григорий Денис Елизавета Инна Константин Лев Матвей Олег Пётр Руслан Семён Тимофей Эдуард".split(),
    "family_ru": "Абрамов Белова Виноградов Громова Дмитриев Ефимова Жуков Зайцева Ильин Комарова Литвинов Морозова Никитин Орлова Поляков Рябова Сидоров Тарасова Ушаков Филиппова Харитонов Цветкова Чернов Шевченко Щукин Яковлева Кравец Мельник Бондаренко Гайдук Савицкий Островская".split(),
    "surname_zh": "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓韩冯曹", "given_zh": "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰建国志文海燕云飞雪梅红宇轩梓涵",
    #: Parts of made-up family names and streets.
    "heads": "Reh Kirsch Nuss Ains Fels Moor Arn Brock Clif Dun Ell Far Glen Hav Ket Lang Mor Nor Oak Pem Rav Sto Thorn Wal Eich Birk Stein Gold Hirsch Berg Falk Wolf Roth Lind Holm West Sund Gran Bel Mont Val Cas Ver Sol Tan Kes".split(),
    "tails": "schmidt baum horn hagen sworth ville court mann stein bach feld berg wald hauer laub meyer ström gren quist strand ridge well worth more land ley smith ard eau elli ini ario ez ado eira ovic enko sson sen ter ler iel und".split(),
    "towns": "bury chester field gate hurst leigh minster port ridge ton burg dorf hausen rode furt court mont vall pueblo ovo insk".split(),
    "domains": "mailbox office north team inbox company webpost firm uni-west k9 letterbox acme-works studio41 metro archive blue-sky kontor atelier correo pochta".split(),
    "suffixes": "example invalid test example.org example.com example.net com org net de fr es ru cn co.uk io info eu".split(),
    "street_words": {
        "en": "Station Chestnut Victoria Orchard Abbey Park Windmill Meadow Lincoln Prospect Pine Cedar Bishop Spring River Kings Grange Holly Canal Forge Priory Walnut Sunset Franklin Dover".split(),
        "de": "Bahnhof Goethe Rosen Schiller Ulmen Acker Garten Wald Schul Berg Blumen Nelken Fichten Eichen Burg Ring Sonnen Post Wiesen Birken Amsel Tal Stern Kloster Markt".split(),
        "fr": "République Victoire Lilas Lavoir Église Loire Cerisiers Fontaine Paix Château Écoles Roses Platanes Liberté Mairie Forge Vallée Prés Chênes Halles Gare Remparts".split(),
        "es": "Alcalá América Prado España Toledo Pinos Sol Paz Fuente Iglesia Rosales Reyes Libertad Castillo Flores Estación Jardín Olivos Parque Colegio Santa-Ana Cid".split(),
        "ru": "Гагарина Мира Лесная Почтовая Чехова Полевая Победы Заречная Новая Школьная Центральная Зелёная Советская Молодёжная Комсомольская Луговая Вокзальная Парковая".split(),
        "zh": "人民 中山 解放 和平 建设 文化 東湖 青年 胜利 光华 花园 学院 西山 朝阳 红旗 友谊".split(),
    },
    "street_kinds": {
        "en": "Street Road Lane Avenue Close Way Crescent Drive Court Place Terrace Row Grove Hill Gardens Square Walk Mews Boulevard St. Rd Ave. Blvd Dr.".split(),
        "de": "straße weg gasse platz allee ring ufer damm steig str. hof graben bogen stieg markt".split(),
        "fr": "rue avenue boulevard impasse chemin place quai allée cours passage av. bd. ruelle sentier square".split(),
        "es": "Calle Avenida Paseo Plaza Ronda Camino Travesía Avda. C/ Pza. Pº Callejón Carretera Av.".split(),
        "ru": "ул. улица пр. проспект пер. переулок наб. бул. шоссе пл. проезд".split(),
        "zh": "路 街 巷 大道 大街 胡同 里".split(),
    },
    "things": {
        "en": "Station Bridge City Museum Hotel University Park Library Harbour Tower Market Airport Festival Company Hospital Theatre Castle Lake River Valley Quay Wharf Ferry Depot Warehouse Terminal Gate School Hall Club Review Office Island Canal".split(),
        "de": "Bahnhof Brücke Museum Hotel Universität Park Bibliothek Hafen Turm Markt Flughafen Fest Werke Klinik Theater Schloss See Tal Kai Fähre Speicher Lager Tor Schule Halle Verein Rathaus Insel Kanal Dom".split(),
        "fr": "Gare Pont Musée Hôtel Université Parc Bibliothèque Port Tour Marché Aéroport Festival Ateliers Hôpital Théâtre Château Lac Vallée Quai Bac Hangar Dépôt Porte École Salle Club Mairie Île Canal".split(),
        "es": "Estación Puente Museo Hotel Universidad Parque Biblioteca Puerto Torre Mercado Aeropuerto Festival Talleres Hospital Teatro Castillo Lago Valle Muelle Barco Almacén Puerta Escuela Sala Club Ayuntamiento Isla Canal".split(),
        "ru": "Вокзал Мост Музей Гостиница Университет Парк Библиотека Порт Башня Рынок Аэропорт Завод Больница Театр Замок Причал Паром Склад Ворота Школа Зал Клуб Остров Канал".split(),
        "zh": "车站 大桥 博物馆 酒店 大学 公园 图书馆 港口 塔 市场 机场 工厂 医院 剧院 码头 渡轮 仓库 学校".split(),
    },
    "adjectives": {
        "en": "Central New Old Great Royal Northern Upper National Grand Eastern Lower Saint Red Silver".split(), "de": "Neue Alte Große Kleine Obere Zentrale Königliche Nördliche Rote Untere".split(),
        "fr": "Grand Nouvelle Vieux Royal Central Petit National Haute".split(), "es": "Nuevo Viejo Gran Real Central Nacional Alto Santa".split(),
        "ru": "Новый Старый Большой Малый Центральный Северный Красный Верхний".split(), "zh": "新 老 大 中央 北 东 红".split(),
    },
    "nouns": {
        "en": "garden letter soup engine window teacher road winter ticket paper kitchen doctor water music driver morning price report summer table answer bottle horse shop neighbour meeting shelf invoice parcel story".split(),
        "de": "Garten Brief Suppe Motor Fenster Lehrer Straße Winter Karte Papier Küche Arzt Wasser Musik Fahrer Morgen Preis Bericht Sommer Tisch Antwort Flasche Pferd Laden Nachbar Sitzung Regal Rechnung Paket Geschichte Wind Schnee Sonne Wolke Leute Kinder Besucher Gäste Mieter Fahrgast Bewohner Händler Bürger Zeitung Wohnung Leitung Ordnung Freiheit Tätigkeit Bäckerei Nachmittag Werkzeug".split(),
        "fr": "jardin lettre soupe moteur fenêtre professeur route hiver billet papier cuisine médecin eau musique chauffeur matin prix rapport été table réponse bouteille cheval boutique voisin réunion étagère facture colis histoire".split(),
        "es": "jardín carta sopa motor ventana maestro camino invierno billete papel cocina médico agua música chófer mañana precio informe verano mesa respuesta botella caballo tienda vecino reunión estante factura paquete historia".split(),
        "ru": "сад письмо суп мотор окно учитель дорога зима билет бумага кухня врач вода музыка водитель утро цена отчёт лето стол ответ бутылка лошадь лавка сосед встреча полка счёт посылка рассказ".split(),
        "zh": "花园 信件 汤 发动机 窗户 老师 道路 冬天 车票 纸 厨房 医生 水 音乐 司机 早晨 价格 报告 夏天 桌子 答案 瓶子 马 商店 邻居 会议 架子 账单 包裹 故事".split(),
    },
    "verbs": {
        "en": "was late,costs less than the,stands behind the,needs a new,arrived with the,is next to the,broke before the,was sold with a,fits the,changed every".split(","),
        "de": "kam spät,kostet weniger als,steht hinter,braucht neue,kam mit,liegt neben,brach vor,wurde verkauft mit,passt zu,ändert jede".split(","),
        "fr": "est en retard,coûte moins que la,se trouve derrière la,demande un autre,arrive avec le,est à côté du,a cassé avant le,se vend avec une,convient au,change chaque".split(","),
        "es": "llegó tarde,cuesta menos que la,está detrás de la,necesita otro,vino con el,queda junto al,se rompió antes del,se vendió con una,encaja con el,cambia cada".split(","),
        "ru": "опоздал,стоит меньше чем,стоит за,требует новый,прибыл как,лежит там где,сломался раньше чем,продан вместе как,подходит под,меняет каждый".split(","),
        "zh": "迟到了,比较便宜的,在后面的,需要新的,带来了,旁边是,坏了所以换,卖给了,适合,改变了每个".split(","),
    },
    "openers": {
        "en": ["", "", "", "", "Last week ", "Note: ", "PS: ", "As agreed, ", "Today ", "In short, ", "Please note that ", "By the way, "], "de": ["", "", "", "", "Hinweis: ", "PS: ", "Wie besprochen: ", "Kurz gesagt: ", "Zur Info: "],
        "fr": ["", "", "", "", "La semaine dernière, ", "Note : ", "PS : ", "Comme convenu, ", "Aujourd'hui, "], "es": ["", "", "", "", "La semana pasada ", "Nota: ", "PD: ", "Según lo acordado, ", "Hoy "],
        "ru": ["", "", "", "", "На прошлой неделе ", "Примечание: ", "P.S. ", "Как договорились, ", "Сегодня "], "zh": ["", "", "", "", "上周，", "备注：", "另外，", "按照约定，", "今天"],
    },
    #: Words that begin a sentence and that a capitalised word may follow; links between a noun and a town; measure words.
    "starts": {
        "en": "The A Two Three Some On In At Our This Many From Every Near".split(), "de": "Der Die Das Eine Zwei Drei Vier Mehrere Viele Einige Alle Keine Unsere Diese Am Im Zum Bei Aus Nach".split(),
        "fr": "Le La Les Un Deux Trois Nos Cette Chaque Ce Des À Sur Vers Quelques".split(), "es": "El La Los Un Dos Tres Cada Este Nuestra En Desde Varios Para Algunos".split(),
        "ru": "Две Три Наш Эта Каждый Все В На Из Этот У Около".split(), "zh": "这 那 两个 三个 每个 我们的 在 从 所有".split(),
    },
    "links": {"en": ["of ", "from ", "near ", ""], "de": ["von ", "aus ", "in ", "bei ", ""], "fr": ["de ", "de ", "à ", "près de "], "es": ["de ", "de ", "en ", "cerca de "], "ru": ["из ", "в ", "", "", ""], "zh": ["在", "离", "到"]},
    #: Stems of German adjectives, whose nouns are capitalised like names.
    "stems": "kalt warm lang kurz schön gut schlecht hell dunkel frisch leicht laut leise billig teuer nass trocken eng breit glatt rau süß sauer hart weich früh spät fremd eigen ganz halb letzt erst nächst viel wenig".split(),
    #: Small words that hold sentences together.
    "small": {
        "en": "the a and or but that which who with without for from to of in on at by about after before is was has had will would can told saw met asked gave took still never again only very his her their its my your it he she they we not because while than more walked wants found heard called said".split(),
        "de": "der die das ein eine und oder aber dass welche wer mit ohne für von zu aus in auf an bei über nach vor ist war hat hatte wird kann sagte sah traf fragte gab nahm noch nie wieder nur sehr sein ihr ihre mein unser es er sie wir nicht weil als mehr ging will wollte fand hörte rief stand bekommt kommt wohnt arbeitet den dem im am".split(),
        "fr": "le la les un une et ou mais que qui avec sans pour de du des à au dans sur chez par après avant est était a avait sera peut dit vu croise demande donne prend encore jamais toujours très son sa ses leur mon notre il elle on nous ne pas car plus marche veut trouve entend appelle habite travaille".split(),
        "es": "el la los un una y o pero que quien con sin para de del a al en sobre por tras antes es era ha había será puede dijo vio encontró pidió dio tomó aún nunca siempre muy su sus mi nuestro él ella ya no porque más anda quiere halla oye llama vive trabaja cuando donde hay".split(),
        "ru": "и или но что кто с без для от до из в на у по о после перед был была есть будет может сказал видел встретил просил дал взял ещё никогда снова только очень его её их мой наш он она мы не потому чем больше идёт хочет нашёл живёт работает когда где там уже".split(), "zh": "的 了 和 在 是 有 不 也 就 把 给 对 从 到 很 还 他 她 我们 因为 但是 如果 说 看 去 来 要 会".split(),
    },
    #: Nouns that a number follows.
    "numbered": {
        "en": "room page line chapter platform volume floor class seat bus".split(), "de": "Zimmer Seite Linie Kapitel Gleis Band Etage Klasse Platz Bus Abschnitt Raum Stufe Halle Nummer Spur Route Tafel".split(), "fr": "chambre page ligne chapitre voie tome étage classe place bus section".split(),
        "es": "sala página línea capítulo andén tomo planta clase asiento bus tramo".split(), "ru": "комната страница линия глава путь том этаж класс место автобус участок".split(), "zh": "房间 页面 线路 章节 站台 楼层 座位 班级".split(),
    },
    "units": {
        "en": "km metres kg hours minutes euros times pages litres degrees watts cars".split(), "de": "km Meter kg Stunden Minuten Euro Mal Seiten Liter Grad Watt Autos".split(), "fr": "km mètres kg heures minutes euros fois pages litres degrés watts voitures".split(),
        "es": "km metros kg horas minutos euros veces páginas litros grados vatios coches".split(), "ru": "км метров кг часов минут рублей раз страниц литров градусов ватт машин".split(), "zh": "公里 米 公斤 小时 分钟 元 次 页 升 度 辆 号 年 月 人 天 轮 个 件 号线 名 岁 层 倍".split(),
    },
    "han": "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所民得经十三之进着等部度家电力里如水化高自二理起小物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天政四日那社义事平形相全表间样与关各重新线内数正心反你明看原又么利比或但质气第向道命此变条只没结解问意建月公无系军很情者最立代想已通并提直题党程展五果料象员革位入常文总次品式活设及管特件长求老头基资边流路级少图山统接知较将组见计别她手角期根论运农指几九区强放决西被干做必战先回则任取据处队南给色光门即保治北造百规热领七海口东导器压志世金增争济阶油思术极交受联什认六共权收证改清己美再采转更单风切打白教速花带安场身车例真务具万每目至达走积示议声报斗完类八离华名确才科张信马节话米整空元况今集温传土许步群广石记需段研界拉林律叫且究观越织装影算低持音众书布复容儿须际商非验连断深难近矿千周委素技备半办青省列习响约支般史感劳便团往酸历市克何除消构府称太准精值号率族维划选标写存候毛亲快效斯院查江型眼王按格养易置派层片始却专状育厂京识适属圆包火住调满县局照参红细引听该铁价严",
    #: By language and slot what may stand before and after it.
    "phrases": {
        "en": {
            "N": (["invoice for ", "dear ", "her colleague ", "yours sincerely, ", "the tenant ", "patient ", "a letter from ", "written by ", "please ask ", "with kind regards, ", "we spoke with ", "the engineer ", "minutes taken by ", "applicant: ", "", "", "", "for the attention of ", "as ", "cc: ", "later "],
                  [", due at once", ", your parcel is ready", " can be reached all day", " moved out last year", " was discharged", " has the spare key", " will call back", " asked for a copy", " wrote that the soup was cold", " and the neighbour agreed", "", "", "", " said so twice", ": approved", " never answered", " owns the dog", " explained, the door was open", " from accounts"]),
            "E": (["mail ", "for bookings use ", "reply-to: ", "send the form to ", "or drop a line at ", "e-mail: ", "my new address is ", "copy in ", "subscribe through ", "", "reach me under ", "bounced from "], [" for details", " before noon", "", "", ", not the old one", " (work)", " is no longer read", " with your order number", "; we reply the same day"]),
            "P": (["for bookings dial ", "tel. ", "phone: ", "mobile ", "text me on ", "fax ", "the office line is ", "ring ", "reach us at ", "", "emergency contact ", "leave a message on ", "hotline: "], [" between nine and five", "", "", " (evenings only)", " and ask for the chef", ", no texts", " does not work today", " or come round", " after the beep"]),
            "I": (["passport or ID: ", "social security no. ", "tax number ", "national insurance ", "identity card ", "SSN ", "personal code ", "with document ", "holder of ", "", "registered under ", "born in May, "], [", was refused", "", "", " (copy attached)", " is on file", ", expires soon", " does not match", " was checked by the bank", ", resident"]),
            "A": (["billing address: ", "deliver to ", "moved to ", "she lives at ", "the flat at ", "our shop at ", "come to ", "found outside ", "", "registered office ", "a fire at ", "between the park and ", "opposite "], [" last year", ", third floor", "", "", " is for rent", ", ring twice", " has a blue door", " until June", " by courier", ", rear entrance"]),
        },
        "de": {
            "N": (["Rechnung an ", "Guten Tag ", "die Kollegin ", "mit freundlichen Grüßen, ", "die Mieterin ", "Patient ", "ein Brief von ", "geschrieben von ", "fragen Sie bitte ", "gestern hat ", "wir sprachen mit ", "der Ingenieur ", "Protokoll: ", "Antrag von ", "", "", "", "zu Händen ", "als ", "dann kam ", "heute ist "],
                  [", sofort fällig", ", Ihr Paket ist da", " ist den ganzen Tag erreichbar", " zog letztes Jahr aus", " wurde entlassen", " hat den Ersatzschlüssel", " ruft zurück", " bat um eine Kopie", " schrieb, die Suppe sei kalt", " und der Nachbar stimmten zu", "", "", "", " sagte das zweimal", ": genehmigt", " antwortete nie", " besitzt den Hund", " angerufen", " aus der Buchhaltung"]),
            "E": (["Mail: ", "Buchungen über ", "Antwort: ", "das Formular senden an ", "oder schreiben Sie ", "E-Mail ", "meine neue Adresse ist ", "in Kopie ", "anmelden bei ", "", "erreichbar unter ", "zurück kam "], [" für Näheres", " vor Mittag", "", "", ", nicht die alte", " (Büro)", " wird nicht mehr gelesen", " mit Bestellnummer", "; wir melden uns"]),
            "P": (["Buchungen unter ", "Tel. ", "Telefon: ", "mobil ", "SMS an ", "Fax ", "das Büro hat die ", "Rückruf ", "Sie erreichen uns unter ", "", "im Notfall ", "Nachricht auf ", "Durchwahl "], [" zwischen neun und fünf", "", "", " (nur abends)", " und nach dem Koch fragen", ", keine SMS", " geht heute nicht", " oder kommen Sie vorbei", " nach dem Ton"]),
            "I": (["Pass oder Ausweis: ", "Sozialversicherung Nr. ", "Steuernummer ", "Personalausweis ", "Steuer-ID ", "Personenkennzahl ", "mit Dokument ", "Inhaber von ", "", "gemeldet als ", "geboren im Mai, "], [", abgelehnt", "", "", " (Kopie anbei)", " liegt vor", ", läuft bald ab", " stimmt nicht", " wurde von der Bank geprüft"]),
            "A": (["Rechnungsanschrift: ", "liefern an ", "umgezogen: ", "sie wohnt ", "die Wohnung ", "unser Laden ", "kommen Sie zu ", "gefunden vor ", "", "Firmensitz ", "ein Feuer in ", "zwischen Park und ", "gegenüber "], [" im letzten Jahr", ", dritter Stock", "", "", " ist zu vermieten", ", zweimal klingeln", " hat eine blaue Tür", " bis Juni", " per Kurier", ", Hintereingang"]),
        },
        "fr": {
            "N": (["facture pour ", "bonjour ", "sa collègue ", "cordialement, ", "le locataire ", "patient ", "une lettre de ", "écrit par ", "demandez à ", "avec nos salutations, ", "nous avons parlé avec ", "l'ingénieur ", "compte rendu : ", "demande de ", "", "", "", "à l'attention de ", "comme ", "hier "],
                  [", à régler", ", votre colis est prêt", " répond toute la journée", " a déménagé", " est sorti", " a le double des clés", " rappellera", " a demandé une copie", " écrit que la soupe était froide", " et le voisin sont d'accord", "", "", "", " l'a dit deux fois", " : accordé", " n'a jamais répondu", " a un chien", " de la comptabilité"]),
            "E": (["courriel : ", "réservations par ", "répondre à ", "envoyez le formulaire à ", "ou un mot à ", "e-mail ", "ma nouvelle adresse est ", "copie à ", "inscription par ", "", "joignable sur ", "rejeté par "], [" pour les détails", " avant midi", "", "", ", pas l'ancienne", " (bureau)", " n'est plus lu", " avec votre commande"]),
            "P": (["réservations au ", "tél. ", "téléphone : ", "portable ", "SMS au ", "fax ", "le bureau répond au ", "rappeler le ", "joignez-nous au ", "", "urgence ", "message sur le ", "standard : "], [" de neuf à cinq", "", "", " (le soir)", " et demandez le chef", ", pas de SMS", " ne marche pas", " ou passez nous voir", " après le bip"]),
            "I": (["passeport ou carte : ", "sécurité sociale n° ", "numéro fiscal ", "carte d'identité ", "NIR ", "code personnel ", "avec la pièce ", "titulaire de ", "", "inscrit sous ", "né en mai, "], [", refusé", "", "", " (copie jointe)", " au dossier", ", expire bientôt", " ne correspond pas", " vérifié par la banque"]),
            "A": (["adresse de facturation : ", "livrer au ", "parti au ", "elle habite ", "l'appartement du ", "notre boutique, ", "venez au ", "trouvé devant le ", "", "siège : ", "un feu au ", "entre le parc et le ", "en face du "], [" l'an dernier", ", troisième étage", "", "", " est à louer", ", sonnez deux fois", " a une porte bleue", " jusqu'en juin", " par coursier"]),
        },
        "es": {
            "N": (["factura para ", "hola ", "su colega ", "un saludo, ", "la inquilina ", "paciente ", "una carta de ", "escrito por ", "pregunte a ", "atentamente, ", "hablamos con ", "el ingeniero ", "acta: ", "solicitud de ", "", "", "", "a la atención de ", "como ", "ayer "],
                  [", por pagar", ", su paquete está listo", " atiende todo el día", " se mudó", " recibió el alta", " tiene la otra llave", " llamará luego", " pidió una copia", " escribió que la sopa estaba fría", " y el vecino aceptaron", "", "", "", " lo dijo dos veces", ": aprobado", " nunca contestó", " tiene un perro", " de contabilidad"]),
            "E": (["correo: ", "reservas por ", "responder a ", "envíe el formulario a ", "o unas líneas a ", "e-mail ", "mi nueva dirección es ", "copia a ", "altas en ", "", "localizable en ", "devuelto por "], [" para detalles", " antes de mediodía", "", "", ", no la vieja", " (oficina)", " ya no se lee", " con su pedido"]),
            "P": (["reservas en el ", "tel. ", "teléfono: ", "móvil ", "SMS al ", "fax ", "la oficina tiene el ", "devolver llamada al ", "estamos en el ", "", "urgencias ", "mensaje en el ", "centralita: "], [" de nueve a cinco", "", "", " (por la tarde)", " y pregunte por el chef", ", sin SMS", " no funciona hoy", " o venga", " tras la señal"]),
            "I": (["pasaporte o DNI: ", "seguridad social n.º ", "número fiscal ", "carné ", "NIF ", "código personal ", "con documento ", "titular de ", "", "inscrito como ", "nacida en mayo, "], [", denegado", "", "", " (copia adjunta)", " consta", ", caduca pronto", " no coincide", " fue revisado por el banco"]),
            "A": (["dirección de facturación: ", "entregar en ", "se mudó a ", "ella vive en ", "el piso de ", "nuestra tienda en ", "venga a ", "hallado frente a ", "", "sede: ", "un incendio en ", "entre el parque y ", "enfrente de "], [" el año pasado", ", tercer piso", "", "", " se alquila", ", llame dos veces", " tiene la puerta azul", " hasta junio", " por mensajero"]),
        },
        "ru": {
            "N": (["счёт: ", "здравствуйте, ", "коллега ", "с уважением, ", "жилец ", "пациент ", "письмо, автор ", "автор: ", "спросите, где ", "нам ответил ", "инженер ", "протокол: ", "заявка: ", "", "", "", "вниманию: ", "как ", "вчера "],
                  [", к оплате", ", посылка готова", " на связи весь день", " больше тут не живёт", " уже дома", " хранит запасной ключ", " перезвонит", " просит копию", " пишет, что суп холодный", " и сосед согласны", "", "", "", " это повторил", ": одобрено", " не ответил", " держит собаку", " из бухгалтерии"]),
            "E": (["почта: ", "бронь через ", "ответ на ", "бланк отправить на ", "или пишите на ", "e-mail ", "мой новый адрес: ", "копия: ", "запись на ", "", "связь: ", "возврат от "], [" для справок", " до полудня", "", "", ", не старый", " (рабочий)", " больше не читают", " с номером заказа"]),
            "P": (["бронь: ", "тел. ", "телефон: ", "моб. ", "СМС на ", "факс ", "в конторе ", "перезвонить ", "наш номер ", "", "экстренно ", "сообщение на ", "справочная: "], [" с девяти до пяти", "", "", " (вечером)", " и спросите повара", ", без СМС", " сегодня молчит", " или заходите", " после сигнала"]),
            "I": (["паспорт: ", "СНИЛС ", "ИНН ", "удостоверение ", "личный код ", "документ ", "держатель ", "", "записан как ", "дата рождения в мае, "], [", отказано", "", "", " (копия есть)", " в деле", ", скоро истекает", " не совпал", " проверен банком"]),
            "A": (["адрес для счёта: ", "доставка: ", "переезд: ", "она живёт: ", "квартира: ", "наш магазин: ", "приходите: ", "найдено у дома ", "", "офис: ", "пожар: ", "между парком и ", "напротив "], [" в прошлом году", ", третий этаж", "", "", " сдаётся", ", звонить дважды", " с синей дверью", " до июня", " курьером"]),
        },
        "zh": {
            "N": (["发票抬头 ", "尊敬的 ", "同事 ", "此致，", "租客 ", "病人 ", "来信人 ", "作者：", "请问 ", "我们和 ", "工程师 ", "记录：", "申请人：", "", "", "收件人 ", "昨天 "], ["，请付款", " 您好，包裹已到", " 全天在线", " 已经搬走", " 出院了", " 有备用钥匙", " 会回电", " 要一份副本", " 写道汤是冷的", " 和邻居都同意", "", "", " 说了两次", "：批准", " 没有回答", " 养狗", " 在财务部"]),
            "E": (["邮箱：", "预订用 ", "回复 ", "表单发到 ", "或写信到 ", "e-mail ", "我的新地址是 ", "抄送 ", "报名 ", "", "联系 "], [" 了解更多", " 中午前", "", "", "，不是旧的", "（公司）", " 已停用", " 并附订单号"]),
            "P": (["预订请打 ", "电话 ", "手机：", "短信发到 ", "传真 ", "办公室 ", "回电 ", "我们的号码是 ", "", "紧急 ", "留言 ", "热线："], [" 九点到五点", "", "", "（晚上）", " 找厨师", "，不收短信", " 今天不通", " 或直接来", " 之后按一"]),
            "I": (["护照或证件：", "社保号 ", "税号 ", "身份证 ", "证件号码 ", "个人代码 ", "持 ", "", "登记为 ", "五月出生，"], ["，被拒", "", "", "（附复印件）", " 已存档", "，即将过期", " 不符", " 银行已核对"]),
            "A": (["账单地址：", "送到 ", "搬到 ", "她住在", "公寓在", "我们的店在 ", "请来 ", "发现于 ", "", "总部：", "火灾在 ", "公园和 ", "对面是"], [" 去年", "，三楼", "", "", " 出租", "，按两次铃", " 有蓝色的门", " 到六月", " 快递"]),
        },
    },
    "plain": {
        "en": ["Tickets cost {n} on {d}.", "The museum in {t} opens at {n}.", "Order {x} ships from {t}.", "Most of {w} is cobbled.", "See {h} for details.", "Version {x} fixes {n} bugs.", "{c} returns on {d}.", "Item no. {x} is out of stock.", "We took the train from {c} to {c}.", "The yacht {g} and the {g} Mill belong to {c}.", "Rooms {n}, {n} and {n} face {w}.", "Reference {x}, page {n} of {n}.", "The {c} near {t} opened in {n}.", "{w} leads to {c}.", "{t} beat {t} by {n} points.", "Serial {x} and batch {x} were recalled.", "Mr {t} is a cheese.", "He won {n}.{n} euros on {d}.", "{t} {t} Ltd sells {n} bikes."],
        "de": ["Karten kosten {n} am {d}.", "Das Museum in {t} öffnet um {n}.", "Bestellung {x} kommt aus {t}.", "{w} ist gepflastert.", "Näheres bei {h}.", "Version {x} behebt {n} Fehler.", "{c} beginnt am {d}.", "Artikel Nr. {x} ist vergriffen.", "Wir fuhren von {c} nach {c}.", "Das Schiff {g} und die Mühle {g} gehören {c}.", "Die Zimmer {n}, {n} und {n} liegen zum Hof.", "Zeichen {x}, Seite {n} von {n}.", "{c} bei {t} wurde {n} eröffnet.", "{w} führt zu {c}.", "{t} schlug {t} mit {n} Punkten.", "Seriennummer {x} und Charge {x} wurden zurückgerufen.", "Die Stadtwerke {t} liefern Strom.", "Er gewann {n}.{n} Euro am {d}."],
        "fr": ["Les billets coûtent {n} {d}.", "Le musée de {t} ouvre à {n}.", "La commande {x} part de {t}.", "La {w} est pavée.", "Voir {h}.", "La version {x} corrige {n} erreurs.", "{c} commence {d}.", "L'article n° {x} est épuisé.", "Nous allons de {c} à {c}.", "Le bateau {g} et le Moulin {g} sont à {c}.", "Les chambres {n}, {n} et {n} donnent sur la cour.", "Référence {x}, page {n} sur {n}.", "{c}, près de {t}, date de {n}.", "La {w} mène à {c}.", "{t} bat {t} de {n} points.", "La série {x} et le lot {x} sont rappelés.", "Les Usines {t} vendent {n} vélos.", "Il gagne {n}.{n} euros {d}."],
        "es": ["Las entradas cuestan {n} {d}.", "El museo de {t} abre a las {n}.", "El pedido {x} sale de {t}.", "La {w} está empedrada.", "Vea {h}.", "La versión {x} corrige {n} fallos.", "{c} empieza {d}.", "El artículo n.º {x} está agotado.", "Fuimos de {c} a {c}.", "El velero {g} y el Molino {g} son de {c}.", "Las salas {n}, {n} y {n} dan al patio.", "Referencia {x}, página {n} de {n}.", "{c}, cerca de {t}, abrió en {n}.", "La {w} lleva a {c}.", "{t} ganó a {t} por {n} puntos.", "La serie {x} y el lote {x} se retiran.", "Las Bodegas {t} venden {n} cajas.", "Ganó {n}.{n} euros {d}."],
        "ru": ["Билеты стоят {n}, день: {d}.", "Музей в {t} открыт с {n}.", "Заказ {x} едет из {t}.", "{w} вымощена камнем.", "Смотрите {h}.", "Версия {x}: исправлено {n} ошибок.", "{c}: открытие, {d}.", "Товар № {x} закончился.", "Мы ехали от {c} до {c}.", "Яхта {g} и мельница {g} рядом.", "Комнаты {n}, {n} и {n} выходят во двор.", "Шифр {x}, страница {n} из {n}.", "{c} у {t} открыт в {n}.", "{w} ведёт к {c}.", "{t} обыграл {t}: {n} очков.", "Серия {x} и партия {x} отозваны.", "Фабрика «{t}» продаёт {n} велосипедов.", "Выигрыш {n}.{n} евро, {d}."],
        "zh": ["{d}的门票是{n}元。", "{t}的博物馆{n}点开门。", "订单 {x} 从 {t} 发出。", "{w}铺着石板。", "详见 {h}。", "版本 {x} 修复了{n}个错误。", "{c}在{d}开始。", "货号 {x} 缺货。", "我们从 {c} 到 {c}。", "帆船 {g} 和 {g} 磨坊都关了。", "{n}、{n}和{n}号房间朝南。", "编号 {x}，第{n}页共{n}页。", "{t}附近的{c}开业。", "{w}通向{c}。", "{t}以{n}分胜{t}。", "序列号 {x} 和批次 {x} 已召回。", "他中了{n}.{n}元。"],
    },
}

HELD = {
    "given": "Adele Bertram Clarissa Dorothea Edmund Farida Gregor Henrietta Ignacio Jolanda Konrad Lucinda Malcolm Nathalie Oswald Penelope Rafaela Sebastian Theodora Ulrich Veronica Winston".split(),
    "family": "Applegate Bielecki Castellano Drummond Engelhardt Figueroa Grosvenor Hakimi Isaksen Jaramillo Kirchhoff Lavallee McAllister Nyström Ostrowski Pritchard Rousseau Santangelo Tanaka Underhill Vasquez Wetherby".split(),
    "given_ru": "Аркадий Виктор Глеб Елена Захар Людмила Надежда Степан".split(),
    "family_ru": "Богданов Гусева Данилов Киселёва Макаров Панова Тихонов Фролова".split(),
    "surname_zh": "秦尤施孔严魏陶姜", "given_zh": "春林鹏辉婷俊楠琳",
    "domains": "letters clinic south bureau shop-one".split(),
    "suffixes": "example invalid example.net test".split(),
    "towns": "bourne combe stow thorpe wood".split(),
    "heads": "Ayl Bex Chal Dor Ems Grim Hex Inver".split(),
    "tails": "ster ford low man".split(),
    "street_words": {
        "en": "Church Edward Sycamore Highfield Pinfold".split(), "de": "Dorf Beethoven Tannen Tulpen Mozart".split(), "fr": "Pasteur Gambetta Vignes Carnot Moulins".split(), "es": "Goya Colón Gracia Nueva Cádiz".split(),
        "ru": "Пушкина Ленина Набережная Кирова".split(), "zh": "南京 新华 光明 五一".split(),
    },
    "phrases": {
        "en": {"N": (["winner of the raffle: ", "yesterday ", "we have not met "], ["", " phoned", " left the choir"]), "E": (["questions go to "], [" please"]), "P": (["the plumber answers on "], [" all week"]), "I": (["taxpayer "], [" filed late"]), "A": (["he gave "], [" as his home"])},
        "de": {"N": (["gewonnen hat ", "gestern rief ", "Frau und Herr "], [" die Verlosung", " an", ""]), "E": (["Fragen gehen an "], [" bitte"]), "P": (["den Klempner erreicht man unter "], [" täglich"]), "I": (["Steuerpflichtiger "], [" kam zu spät"]), "A": (["als Wohnung gab er "], [" an"])},
        "fr": {"N": (["la tombola revient à ", "on a vu "], ["", " ce matin"]), "E": (["vos questions vont à "], [" merci"]), "P": (["le plombier répond au "], [" chaque jour"]), "I": (["le contribuable "], [" a tardé"]), "A": (["il a donné "], [" comme domicile"])},
        "es": {"N": (["ganó la rifa ", "telefoneó "], [" el sábado", ""]), "E": (["las preguntas van a "], [" por favor"]), "P": (["el fontanero contesta en el "], [" siempre"]), "I": (["el contribuyente "], [" llegó tarde"]), "A": (["dio "], [" como domicilio"])},
        "ru": {"N": (["лотерею выиграл участник ", "пришёл "], ["", " снова"]), "E": (["вопросы сюда: "], [" пожалуйста"]), "P": (["сантехник отвечает: "], [" всю неделю"]), "I": (["плательщик "], [" опоздал"]), "A": (["он назвал дом: "], [" и ушёл"])},
        "zh": {"N": (["抽奖得主是 ", "老板 "], ["", " 来电"]), "E": (["有疑问写给 "], [" 即可"]), "P": (["水管工的号码 "], [" 每天"]), "I": (["纳税人 "], [" 迟交"]), "A": (["他登记的住处是 "], [" 一带"])},
    },
    "plain": {
        "en": ["Snow fell on {t} for {n} hours.", "Bakery prices rose by {n} on {d}.", "Ticket {x} is still open.", "Meet me at {c}."],
        "de": ["In {t} schneite es {n} Stunden.", "Das Brot kostet {d} {n} mehr.", "Vorgang {x} ist noch offen.", "Treffpunkt ist {c}."],
        "fr": ["Il a neigé {n} heures à {t}.", "Le pain coûte {n} de plus {d}.", "Le dossier {x} reste ouvert.", "Rendez-vous devant {c}."],
        "es": ["Nevó {n} horas en {t}.", "El pan sube {n} {d}.", "El caso {x} sigue abierto.", "Nos vemos en {c}."],
        "ru": ["Снег шёл {n} часов, место: {t}.", "Хлеб дороже на {n}, день: {d}.", "Заявка {x} ещё открыта.", "Встреча: {c}."],
        "zh": ["{t}下了{n}小时的雪。", "面包{d}涨了{n}分。", "工单 {x} 仍未关闭。", "在{c}见面。"],
    },
}
HELD = {**TRAINED, **HELD}
