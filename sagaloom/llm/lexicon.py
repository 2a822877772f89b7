"""Words of abuse, hate and explicit sex in seven languages, by class, with the words of context that raise or lower a finding.

Entries are single words or stems (a star at the end: any ending), short fixed expressions of a language (with blanks), and, in
scripts without blanks, strings of characters. No entry carries a category by itself: the classes are features of a sentence.
"""

from __future__ import annotations

#: Classes: INSult (also of other meaning), BAD names (never meant well), DISdain, DIE wishes, HIT (violence), THReats, SHUT (commands to be off), PROFanity, YOU, DESert (ought), VERmin,
#: LOW traits, BASE (lower by birth), OUT (expulsion), GRouP, MAN (may be one), THEY, ALL, IS (naming), SEX acts, NUDity, MOAning, BED and body, CARessing, and the harmless contexts REPort
#: (of such talk), PLAY, BARN (animals and stores), MEDicine, ART and bathing.
LEXICON: dict[str, str] = {
    "INS": """fool fools foolish stupid* dumb dumber dumbest dunce* clown* loser* useless pathetic miserable disgusting repulsive revolting vile filthy filth trash garbage rubbish dung worm worms
        pig pigs swine rat coward* liar liars lying fraud creep creeps weasel* jerk ugly wretch* freak* degenerate* bitch* hideous stinking stink stinks rotten toad blockhead* dullard*
        simpleton* waste lunatic* hypocrite* traitor* dog depp* nutzlos* abschaum dreck* müll schwein* köter ratte feigling* lügner* versager* widerlich* ekelhaft* hässlich* dumm dumme
        dummer dümmer blöd* schwachkopf* mistkerl* mist elend* erbärmlich* jämmerlich* lump lumpen gesindel* esel débile* con conne déchet* merde* pitoyable* nul nulle stupide* sale sales
        dégueulasse* répugnant* moche* laid laide lâche* menteur* menteuse* pourri* porc porcs cochon* larve* inutile* misérable* pauvre-type ignoble* estúpid* tonto tonta tontos inútil*
        basura* mierda* asqueros* repugnan* feo fea cobarde* mentiros* cerdo* rata gusano* patétic* payaso* bastardo* desgraciad* zorra* despreciable* burro дурак* дура дуры тупой тупая
        тупые урод* скотина скоты свинья свиньи ничтожн* мусор дерьм* говн* жалкий жалкая жалкое гад гадина лжец* лгун* трус трусы трусл* бездар* бесполезн* шлюх* сука суки вонюч* мерзк*
        отвратительн* убог* болван* осёл негодя* 垃圾 傻瓜 傻子 王八 猪头 猪 蠢 丑 反胃 恶心 无耻 骗子 狗 癞蛤蟆 渣滓 浆糊 进水 小人 懦夫 软蛋 粪 屎 狗屁 放屁 无能 没用 臭虫 烂人 蛆 ばか ゴミ 無能 ブス 醜い 気持ち悪い 最低 クソ 糞 野郎 卑怯者 嘘つき 愚か 豚 負け犬 ぐず のろま
        worthless wertlos* inútil 进了水 crook crooks""",
    "BAD": """idiot* moron* imbecil* dimwit* halfwit* nitwit* scum* maggot* bastard* brainless brain-dead spineless gutless lowlife* cretin* slut* whore* dirtbag* scumbag* numbskull*
        good-for-nothing dummkopf* trottel* arsch* drecksau* missgeburt* taugenichts hure* schlampe* miststück* crétin* abruti* connard* salaud* salop* ordure* raclure* minable* pute*
        bâtard* fumier* crapule* idiota* imbécil* escoria* malnacid* puta* cretino* pendej* gilipollas* canalla* sinvergüenza* идиот* дебил* кретин* тупица мразь мрази тварь твари
        ничтожеств* отброс* подонок подонк* ублюд* сволоч* придур* мерзав* 废物 白痴 蠢货 蠢猪 笨蛋 傻逼 智障 弱智 脑残 贱人 贱货 人渣 败类 杂种 畜生 混蛋 混账 窝囊废 饭桶 草包 不要脸 坏水 孬种 贱骨头 脏嘴 臭嘴 クズ バカ 馬鹿 アホ 間抜け まぬけ 役立たず 能無し 下衆 ゲス
        ろくでなし 腰抜け abschaum* nichtsnutz* imbécile* 丑八怪 喷粪 满嘴 没脑子 狗东西 能なし 虫けら 满嘴喷粪""",
    "DIS": """waste-of nobody-wants nobody-likes no-one-likes no-one-wants nobody-asked nobody-would-miss no-one-would-miss nobody-needs nobody-loves no-one-loves not-even-your too-ugly too-stupid
        too-dumb cannot-even can-not-even despise* everyone-hates everybody-hates hate-you hates-you ashamed-of-you laughing-stock been-born better-off-without crawl-back makes-me-sick
        make-me-sick disgrace sick-of-you spit-on good-for-nothing of-no-use waste-my-time your-own-mother your-mother embarrassment
        braucht-dich will-dich mag-dich vermisst-dich niemand-braucht keiner-braucht schande zu-dumm zu-hässlich veracht* hasst-dich zu-nichts dich-nicht-ausstehen
        personne-ne-veut personne-ne-t personne-n-aime ne-vaut ne-vaux honte tu-n-es-qu tu-n-es-rien bon-à-rien bonne-à-rien mépris* te-déteste même-ta-mère rien-du-tout
        no-vale no-vales nadie-te nadie-quiere das-asco da-asco vergüenza ni-tu-madre despreci* no-sirve no-sirves te-odia te-odian
        не-нужен не-нужна никому-ты ты-никто тебя-ненавидят презира* позор* терпеть-не-может даже-мать грош
        算老几 算什么东西 什么东西 什么玩意 货色 没人要 没人想 没人在乎 没人喜欢 没救 白养 不如 丢人现眼 浪费 倒霉 欠揍 欠打 吐口水 松一口气 少了你 没有你 恶心人 呸 提鞋 没教养 讨厌 也配 看不起 瞧不起 丢脸 笑柄
        必要としていない 必要ない 価値がない 価値もない 顔を見せるな うざい 恥さらし いらない 誰も 見たくない 嫌われ""",
    "DIE": """drop-dead kill-yourself drown-yourself hang-yourself shoot-yourself jump-off go-die hope-you-die rot-in burn-in-hell go-to-hell stop-breathing you-were-dead choke-on us-all-a-favour
        us-all-a-favor us-a-favour us-a-favor world-a-favour world-a-favor i-hope-the i-hope-you rot-away deserve-to-die should-die
        verreck* krepier* fahr-zur-hölle stirb geh-sterben bring-dich-um häng-dich ersauf* verrotte* verfaul* scher-dich-zum-teufel
        crève* va-mourir va-crever te-pendre te-noyer en-enfer au-diable qu-il-meure pends-toi noie-toi
        muérete* ojalá-te te-mueras al-infierno púdre* te-pudras mátate cuélgate ahógate
        сдох* подохн* чтоб-ты умри убей-себя к-чёрту к-черту в-аду повесься утопись сгинь сгинешь
        去死 死吧 早死 死了算了 不得好死 该死 活该 下地狱 死绝 见鬼去 遭报应 天打雷劈 断子绝孙 怎么不死 找死
        死ね 死んでしまえ 死んじまえ くたばれ 地獄に 地獄へ 失せろ 消えろ 消え失せ""",
    "HIT": """bone bones beat beats beaten beating thrash* smash* strangle* stab stabbed throat slit punch* kill killed murder* find-you regret-it drown hang hanged whip flog* cripple* crush-your
        verprügel* prügel* schlagen schläg* brech* breche knochen töte* umbring* erwürg* abstech* aufschlitz* zusammenschlag* fresse bezahlen bereuen frapper* frappe tuer tuerai casser
        casserai briser* égorg* étrangl* tabass* cogner* poignard* battre battu crever écrase* massacr* golpe* matar* mataré romper* romperé paliza* palos degoll* pegar* estrangul* apuñal*
        arrepent* partiré aplast* бить убью убить изби* палками сломаю врежу задушу получишь кости морду побить придушу 打断 打死 打到 打烂 揍 打你 打一次 宰了 弄死 砍 卸 胳膊 的腿 剥皮 掐死 撕烂 扇你 求饶 等着瞧 捅死 饶不了 打得你 走着瞧
        殺す 殴 痛い目 折って 後悔させ 叩き潰 蹴り""",
    "THR": """break-your break-every hurt-you watch-your-back you-will-pay you-ll-pay come-for-you skin-you crush-you schlag-dich bringe-dich dich-fertig vas-payer vas-a-pagar te-voy-a прибью
        зарежу переломаю пожалеешь 杀了你 收拾你 要你命 要你的命 要你好看 殺してやる ぶっ殺 叩きのめ 覚えてろ 首をへし kill-you beat-you smash-your slit-your cut-your breche-dir schlage-dich te-tuer te-casser te-frapper te-mato
        убью-тебя 弄死你 打断你 饶不了你 宰了你 打死你 卸你""",
    "SHUT": """shut-up shut-your shut-it get-lost get-out go-away piss-off buzz-off bugger-off hold-your-tongue clear-off go-back-to verschwinde halt-dein halt-deine halt-die halt-den maul schnauze
        klappe hau-ab verpiss* zieh-leine kein-wort scher-dich ferme-ta ferme-la la-ferme ta-gueule gueule tais-toi casse-toi dégage* fous-le-camp fiche-le-camp va-t-en hors-d-ici cierra-la
        cierra-el cállate* cállese lárgate* vete fuera-de-aquí заткни* замолчи убирайся вали-отсюда проваливай пошёл-вон пошел-вон закрой-рот пасть исчезни отвали 闭嘴 闭上 住口 少废话 别让我看见 没人想听 黙れ
        帰れ 出て行け うせろ 口を閉じ 近寄るな 二度と だまれ 滚开 滚远 滚出 滚蛋 滚回 给我滚 滚吧 滚一边 快滚""",
    "PROF": """fuck* motherfuck* cunt* asshole* arsehole* shit shithead* dickhead* bullshit son-of-a-bitch wanker* prick twat* fick* scheiß* scheiss* arschloch* wichser* hurensohn* fotze* enculé*
        fils-de-pute va-te-faire putain* nique* joder* cabrón* hijo-de-puta hija-de-puta coño* a-la-mierda chinga* хуй* хуе* пизд* еба* бля бляд* мать-твою нахуй ёба* 操你 他妈的 你妈的 去你妈 日你 婊子
        狗娘养 狗日 傻逼 王八蛋 狗杂种 fuk fcuk fck phuck""",
    "YOU": """you your yours yourself du dich dir dein deine deiner deinem deinen tu te toi ton ta tes tú ti eres tus ты тебя тебе твой твоя твою твоё тобой 你 お前 おまえ てめえ 貴様 あんた""",
    "IS": """is are isn-t aren-t such-a what-a so-ein so-eine bist ist sind est sont n-est eres es son это 是 就是 真是 だ です なんて ばかり 纯属 简直 不过是 真是个""",
    "DES": """deserve deserves deserved should must ought gehört gehören verdien* sollte sollten soll sollen muss müssen mérite* devrait devraient faut doit doivent merece* debe deben debería deberían
        hay-que надо нужно должен должны следует заслужива* пора 该 应该 就该 必须 只配 早该 最好 べき やれ""",
    "VER": """vermin lice louse parasite* plague plagues cockroach* roaches rats animals beasts locusts pest pests subhuman* not-human not-people savages infest* leech* scourge breed swarm mongrel* germs
        ungeziefer* parasit* pest seuche* läuse laus ratten tiere viecher schädling* untermensch* keine-menschen bestien heuschrecken brut maden vieh
        vermine* peste poux rats cafard* animaux bêtes fléau* nuisible* pas-des-hommes pas-des-humains sous-hommes sauterelles bétail
        plaga plagas parásit* alimaña* piojo* ratas animales bestias peste cucaracha* no-son-personas no-son-humanos no-son-gente langostas chusma sabandija*
        паразит* чума зараза вши вошь крысы тараканы животные звери саранча нелюди не-люди вредител* черви скот
        害虫 虫子 寄生虫 老鼠 蝗虫 瘟疫 瘟神 祸害 毒瘤 牲口 禽兽 野兽 不是人 蟑螂 苍蝇 野种 贱种 畜生 麻烦
        虫けら 獣 ゴキブリ 疫病 病原菌 ダニ 人間じゃない 人間ではない 動物 ネズミ ケダモノ""",
    "LOW": """dirty unclean lazy thief thieves thieving steal steals stealing cheat cheats liars crooks criminals born blood filthy savage* barbar* backward not-trust greedy treacherous smell
        dishonest cleaner-without better-without stehlen stiehlt diebe dieb diebisch* lügner* faul faule faules schmutzig* dreckig* blut unrein* primitiv* gauner* verbrecher* betrüger*
        stinken lügen voleur* voler volent paresseu* menteurs sang impur* sauvage* barbare* escroc* criminels fainéant* malhonnête* puent robo robar* roban ladron* ladrón* suci* vagos
        perezos* mentirosos sangre salvaje* delincuente* tramposos apestan воры вор воруют ворьё грязн* ленив* лжив* кровь крови дикари вороват* преступник* обманщик* лгут 天生 生来 血统 脏 懒 贼 小偷
        只会偷 偷 不干净 愚昧 野蛮 肮脏 狡猾 阴险 奸诈 贪婪 不可信 肮脏 汚れ 汚い 穢れ 血 泥棒 盗む 盗み 盗人 怠け 嘘つき 野蛮 信じるな ずるい""",
    "BASE": """inferior* lower-kind lower-race lower-breed lower-sort lower-form by-nature no-soul no-souls soulless never-trust be-trusted minderwertig* von-natur trau-keinem traut-keinem
        inférieur* par-nature jamais-confiance inferior* por-naturaleza te-fíes fiarse confíes по-природе неполноценн* низшая низшие нельзя-доверять нельзя-верить 低人一等 低等 劣等 下贱 骨子里 血里 不配 信不得
        劣等 下等 生まれつき 卑しい 信用できない 信用するな in-their-blood in-the-blood their-blood born-liars born-thieves born-criminals second-class im-blut liegt-ihnen menschen-zweiter dans-le-sang
        en-la-sangre в-крови низшей 生来就 天生就是 天生低 血は""",
    "OUT": """driven-out drive-out drive-them drive-these kick-them throw-them kept-out keep-them keep-these keep-out lock-them lock-up locked-up deport* expel* banish* exterminat* eradicat*
        wiped-out wipe-them rid-of let-them beat-them send-them belong-here belongs-in not-be-allowed not-allow no-right without-them away-from-our out-of-our shut-them hunt-them chase-them
        our-school our-schools our-children our-streets our-women our-town our-city our-land burn-them the-world-would be-cleaner decent-people marry go-home vertrieb* vertreib* verjag*
        weg-mit ausrott* einsperr* eingesperrt abschieb* abgeschoben fernhalten fern-von darf-nicht dürfen-nicht vernicht* auslösch* verbrenn* kein-recht wegjag* rauswerf* hinauswerf* raus
        unsere-schulen chasser* chassez chassés expuls* dehors extermin* pas-le-droit droit-de-vivre enferm* bannir* éliminer* brûler* loin-de-nos renvoy* chez-eux interdire* interdits
        nos-écoles nos-enfants nos-villes echar* echarlos expuls* fuera extermin* encerr* no-deberían prohibi* deport* eliminar* quemar* lejos-de derecho-a nuestras-escuelas nuestros-hijos
        nuestro-pueblo гнать выгнать прогнать изгнать вон-отсюда выслать уничтож* истреб* нельзя-жить запрет* запереть сжечь не-пускать рядом-с-нами отсюда депорт* выселить наших-детей 赶出 赶走
        赶下 驱逐 轰出 清理 消灭 灭绝 关起来 烧掉 烧光 不许 不准 别让 不能让 滚出 滚回 进城 踩死 打死 杀光 一个不留 别留 同坐 通婚 隔离 不可惜 才干净 绝不能 追い出 追放 追い払 近寄るな 出て行け 入れるな 滅ぼ 殲滅 閉じ込め 排除 絶滅 来るな 許すな 叩き出 近づけるな 住む資格 焼き払 drive-him-out forced-out
        avoir-le-droit starve burn-every burn-their""",
    "GRP": """foreigner* stranger strangers outsider* immigrant* migrant* refugee* people folk folks clan clans tribe tribes race races natives gyps* jews muslims arabs christians peasants women
        those-people these-people ethnic* speakers newcomers fremde fremden fremder ausländer* leute volk völker stamm stämme rasse rassen sippe sippen flüchtling* zigeuner* juden muslime
        frauen pack einwanderer* bauernpack étranger* gens peuple* race races tribu* immigré* migrant* réfugié* juifs musulmans arabes gitan* femmes ces-gens forastero* extranjero* gente
        pueblo raza razas tribu* inmigrante* migrante* refugiad* gitano* judío* moros mujeres esa-gente чужак* иностран* приезж* народ* племя племен* люди раса расы беженц* мигрант* цыган*
        евреи мусульман* понаехавш* женщины бабы 族 外乡人 外地人 外国人 异乡人 异族 蛮子 蛮夷 胡人 番人 乡下人 南方人 北方人 山里人 外人 人都 民 户 这群人 那群人 这些人 那些人 这帮人 那帮人 一群 女人 难民 移民 黑人 白人 犹太人 穆斯林 土人 后代 子孙 よそ者 外国人 民 部族 連中 奴ら やつら
        人種 民族 異人 移民 難民 女ども 一族 どもは どもを""",
    "MAN": """人 者 Leute""",
    "THEY": """they them their theirs sie ihnen ihre ihrer ils elles eux leur leurs ellos ellas ellas они их им ими 他们 她们 它们 彼ら""",
    "ALL": """all every each none never always everyone alle jeder jede allen nie niemals tous toutes chaque aucun jamais todos todas nunca ninguno cada все всех всем каждый никогда 凡是 所有 一切 全都 个个
        每一个 永远 绝不 全員 みんな すべて 皆""",
    "SEX": """had-sex have-sex having-sex made-love making-love make-love sex intercourse sexual* orgasm* climax* masturbat* blow-job copulat* penetrat* erection* penis vagina nipple* genital*
        porn* courtesan* prostitut* brothel* fucked fucking sex miteinander-geschlafen schliefen-miteinander liebten-sich gefickt ficken vögelte* orgasm* höhepunkt geschlechtsverkehr
        beischlaf* befriedig* sexe baisa baisé baiser baisent coït* orgasm* pénétr* jouir jouit jouissance* sodomi* fellation* sexo follar* follaron follaba* penetr* coito*
        relaciones-sexuales fornic* секс* занимались-любовью занялись-любовью трах* совокуп* соити* минет* 做爱 性交 交欢 交合 交媾 云雨 翻云覆雨 房事 床笫 性爱 高潮 淫 厮混 苟合 行房 口交 自慰 阴茎 阴道 乳头 下体 插入 抽插 鱼水之欢 嫖 叫床 交わっ
        交わり セックス 抱き合 性交 愛し合 情事 絶頂 挿入 射精 愛撫 淫ら faire-l-amour firent-l-amour fit-l-amour fait-l-amour hicieron-el-amor hizo-el-amor hacer-el-amor thrusting thrusts""",
    "NUD": """naked nude undress* bare stripped disrobed tore-off took-off clothes-off unclothed topless nackt* zogen-sich-aus zog-sich-aus sich-aus auszog* entkleid* entblöß* ausgezogen ausgezogene
        nu nue nus nues déshabill* dénud* dévêtu* desnud* desvest* desvist* se-quitaron la-ropa голая голый голые голую голым догола обнажён* обнажен* разделись раздел разделась нагая нагой нагие нагишом
        脱光 赤裸 裸体 裸身 一丝不挂 赤身 光着身子 褪尽 褪去 衣襟 扯开 宽衣解带 剥光 裸 全裸 脱い 脱ぎ 素肌""",
    "MOA": """moan* groan* pant panting panted gasp* lust lustful* arous* writh* ecsta* passionate* cried-out stöhn* keuch* lust lüstern* erreg* wollüst* begierde* gémi* halet* lascif* désir extase
        gemía gemían gemido* gemir gimió jade* lujuri* placer excitad* éxtasis стонал* стон стоны стонет задыха* похот* страст* вожделе* извива*
        呻吟 喘息 娇喘 浪叫 喘 扭动 欲火 情欲 缠在 缠绵 销魂 喘い 喘ぎ あえぎ 悶え 快楽 欲情 よがり""",
    "BED": """bed mattress thigh* breast* hips buttock* kissed kissing sweat mounted rode against-the-wall bodies lap bett schenkel* brüste brust hüften küsste* körper haut setzte-sich-auf
        unter-dem lit draps cuisse* sein seins poitrine hanches embrass* corps sous-le peau cama sábanas muslo* pechos senos caderas besó besaba cuerpo* piel encima постел* кровать кровати
        бедра бёдра грудь целова* тело тела кожу под 床上 榻上 身子 腰肢 大腿 胸脯 搂 搂着 按在 压在 娼妓 寡妇 情妇 肌肤 身体 ベッド 布団 寝床 胸 乳房 太腿 唇 肌""",
    "CAR": """straddl* lick licked licks licking caress* between-the-legs leckte* streichel* lécha* léché* caress* lamió lamía acarici* лизал* ласкал* 吻遍 舔 骑在 抚摸 舐め lizal* 吮 撫で回""",
    "REP": """moderator* removed deleted delete fined fine banned apolog* condemn* scold* punish* rebuk* reported reprimand* insult insults insulted comments complaint* offensive slur slurs unacceptable wrong-to forbid* rule rules
        gelöscht entfernt bestraf* moderator* entschuldig* gerügt verurteil* gemeldet beleidig* kommentare beschwerde* ermahn* verboten
        supprim* modérat* amende* condamn* excus* commentaires insult* réprimand* sanction* interdit-de règlement
        moderador* borrad* multa* conden* disculp* insult* comentarios denunci* reprendi*
        удалил* удаля* модератор* штраф* осуди* осужда* извин* оскорбл* комментари* жалоб* отчита* наказа*
        一律 删除 斥责 训斥 批评 罚 道歉 举报 谴责 说这种话 骂人 有人骂 评论里 版主 管理员 劝阻 制止 警告 规定 当场
        削除 注意し 叱 謝 罰 批判 苦情 報告 言葉遣い 管理人 戒め""",
    "PLAY": """chess game games play plays played player actor* actress* stage theatre theater rehears* puppet* novel comedy tragedy schach spiel* theater bühne schauspiel* rolle
        échecs jeu jouer joue jouait théâtre scène acteur* pièce rôle comédie ajedrez juego jugar jugaba teatro escena actor* papel comedia шахмат* игра* играл* театр* сцен* актёр* актер* пьес* роль
        下棋 斗棋 棋 戏 台上 演 比武 切磋 剧 台词 角色 扮 将棋 芝居 舞台 役者 演じ 試合 稽古 囲碁""",
    "BARN": """granary barn attic cellar stable stables kennel loft farm farmer* harvest grain cat cats trap traps trapped mill orchard garden ship-s-hold speicher scheune* keller katze* stall
        ställe bauer bauern ernte feld hof korn garten falle* grenier* grange* cave chat chats récolte* champ champs étable* piège* jardin* granero* gato gatos sótano* establo* granja*
        cosecha* trampa* huerto* maíz амбар* сарай* погреб* кошк* кот ферм* урожа* зерн* ловушк* подвал* огород* 粮仓 仓 谷 田里 院子 厨房 看门 猫 捕 猎 圈 庄稼 灶 倉 納屋 畑 猫 農 罠 蔵 台所""",
    "MED": """doctor* physician* patient patients nurse* medical examin* treatment infection vaccine anatomy surgeon* clinic* hospital* midwife arzt ärzt* patient* untersuch* kranken* klinik* behand* medizin*
        médecin* docteur* examin* malad* hôpital* soigne* médic* doctor* paciente* enfermed* hospital* врач* доктор* пациент* осмотр* осматрив* больн* лечен*
        大夫 医 药 诊 郎中 疫苗 检查 产妇 哺乳 医者 医師 診 薬 治療 患者 検査""",
    "ART": """painting* statue* marble sculpt* museum* portrait* flame flames naked-eye naked-truth bathed bathing bath washed gemälde statue* marmor museum* baden badete* bad flamme*
        statue* marbre tableau* musée* sculpt* bain bains flamme* estatua* mármol museo* cuadro* escult* baño* llama картин* статуя* мрамор* музе* скульпт* баня бане купал*
        雕像 壁画 沐浴 洗澡 温泉 赤脚 画像 彫像 風呂 絵画""",
}
