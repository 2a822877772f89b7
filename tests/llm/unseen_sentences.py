"""Sentences for problem 10 written without looking at the lexicon: (category, sentence), and harmless look-alikes."""

FOUND = [
    ("abuse", "You are nothing but a stupid liar and I hope you choke on your own words."), ("abuse", "Listen, you useless moron, go jump off a bridge."), ("abuse", "She is a disgusting cow and everyone hates her."),
    ("abuse", "I swear I will smash your skull, you cowardly bastard."), ("abuse", "What a pathetic loser you are."), ("abuse", "Shut your mouth, you ugly witch."), ("abuse", "Nobody would miss a worthless wretch like you."),
    ("hate", "Foreigners are parasites and must be thrown out of our town."), ("hate", "Those people are savages who should never be allowed near our children."), ("hate", "All gypsies are thieves, drive them out."), ("hate", "The marsh folk are an inferior race and deserve to be exterminated."),
    ("sexual", "They undressed and had sex on the kitchen table."), ("sexual", "He kissed her naked breasts while she moaned with pleasure."), ("sexual", "She straddled him, panting, until they both reached orgasm."), ("sexual", "His naked body pressed her thighs apart and she groaned with lust."),
    ("abuse", "Du dumme Sau, verrecke endlich!"), ("abuse", "Halt die Klappe, du nutzloser Trottel."), ("abuse", "Er ist ein widerlicher Lügner und ein Versager."), ("abuse", "Ich breche dir alle Knochen, du feiges Schwein."), ("abuse", "Niemand braucht dich, du erbärmlicher Wicht."), ("abuse", "Verpiss dich, du Arschloch."),
    ("hate", "Ausländer sind Parasiten und müssen raus."), ("hate", "Diese Leute sind von Natur aus faul und Diebe."), ("hate", "Die Bergstämme sind keine Menschen, man sollte sie ausrotten."), ("hate", "Zigeuner sind Ungeziefer, jagt sie aus dem Dorf."),
    ("sexual", "Sie zog sich nackt aus und stöhnte vor Lust."), ("sexual", "Er leckte ihre Brüste, bis sie keuchte."), ("sexual", "Die beiden hatten Sex im Heu."), ("sexual", "Nackt auf dem Bett keuchten sie bis zum Orgasmus."),
    ("abuse", "Tu es vraiment une ordure, va crever."), ("abuse", "Ta gueule, espèce de connard."), ("abuse", "Quel abruti, il est trop bête pour vivre."), ("abuse", "Je vais te casser la figure, sale menteur."), ("abuse", "Tu ne vaux rien, pauvre imbécile."), ("abuse", "Dégage, salope, tu me dégoûtes."),
    ("hate", "Les immigrés sont des parasites qu'il faut expulser."), ("hate", "Ces gens sont des sauvages, ils ont le vol dans le sang."), ("hate", "Les gitans sont tous des voleurs, dehors !"), ("hate", "Cette race inférieure devrait être exterminée."),
    ("sexual", "Ils firent l'amour toute la nuit dans le grenier."), ("sexual", "Nue sur le lit, elle gémissait de plaisir."), ("sexual", "Il caressa ses seins nus et elle haleta."), ("sexual", "Elle se déshabilla et ils baisèrent contre le mur."),
    ("abuse", "Eres un pedazo de basura, ojalá te mueras."), ("abuse", "Cállate, estúpida, nadie te quiere."), ("abuse", "Ese payaso es un cobarde y un mentiroso asqueroso."), ("abuse", "Te voy a romper los huesos, desgraciado."), ("abuse", "Vete a la mierda, hijo de puta."), ("abuse", "Das asco, gusano inútil."),
    ("hate", "Los inmigrantes son ratas y hay que expulsarlos."), ("hate", "Los gitanos son todos ladrones por naturaleza."), ("hate", "Esa gente es inferior y no debería vivir aquí."), ("hate", "Los extranjeros son parásitos, fuera de nuestro pueblo."),
    ("sexual", "Se desnudaron y follaron en la cama."), ("sexual", "Él le lamió los pechos mientras ella gemía."), ("sexual", "Tuvieron sexo salvaje toda la noche."), ("sexual", "Desnuda y jadeando, llegó al orgasmo."),
    ("abuse", "Ты тупая скотина, заткнись."), ("abuse", "Да чтоб ты подох, урод."), ("abuse", "Он просто жалкий трус и лжец, ничтожество."), ("abuse", "Я тебе все кости переломаю, сволочь."), ("abuse", "Пошёл вон, дебил."), ("abuse", "Никому ты не нужна, дура."),
    ("hate", "Все приезжие воры, гнать их надо."), ("hate", "Цыгане это паразиты, их надо уничтожить."), ("hate", "Эти люди дикари, низшая раса."), ("hate", "Мигранты как тараканы, выгнать всех."),
    ("sexual", "Они разделись и занимались сексом в бане."), ("sexual", "Голая, она стонала от страсти."), ("sexual", "Он целовал её голую грудь и бёдра."), ("sexual", "Они трахались всю ночь."),
    ("abuse", "你这头蠢猪，给我滚出去！"), ("abuse", "他就是个没用的废物，谁见了都恶心。"), ("abuse", "再敢来我就打断你的狗腿。"), ("abuse", "像你这种人渣怎么不去死。"), ("abuse", "闭嘴吧，白痴，没人想理你。"), ("abuse", "你算什么东西，不要脸的贱货。"), ("abuse", "信不信老子弄死你，王八蛋。"),
    ("hate", "外地人都是小偷，应该全部赶走。"), ("hate", "这些蛮子不是人，是畜生，杀光才好。"), ("hate", "那个民族天生低劣，骨子里就脏。"), ("hate", "难民就是寄生虫，不许他们进来。"), ("hate", "山里人又懒又脏，都是贼，滚回山里去。"),
    ("sexual", "两人脱光衣服在床上做爱。"), ("sexual", "她赤裸着身子，娇喘连连，呻吟不止。"), ("sexual", "他吻着她的乳房，手伸向大腿之间。"), ("sexual", "他们在客栈里云雨了一整夜。"),
    ("abuse", "お前は本当に役立たずのバカだな。"), ("abuse", "死ね、このクソ野郎。"), ("abuse", "あいつは最低のゲスだ、気持ち悪い。"), ("abuse", "ぶっ殺してやる、覚えてろ。"), ("abuse", "黙れ、ブス、誰もお前を必要としていない。"), ("abuse", "てめえみたいなゴミは消えろ。"),
    ("hate", "外国人は寄生虫だ、追い出せ。"), ("hate", "あの部族は生まれつきの泥棒だ。"), ("hate", "移民どもは獣だ、全員追放しろ。"), ("hate", "奴らの一族は汚い血だ、村に入れるな。"),
    ("sexual", "二人は裸で抱き合い、激しく交わった。"), ("sexual", "彼女は全裸で喘ぎ声を上げた。"), ("sexual", "彼は彼女の乳房を舐め、愛撫した。"), ("sexual", "二人はベッドで何度もセックスをした。"),
]

HARMLESS = [
    "The farmer drove the rats out of the granary.", "The garbage is collected on Tuesdays.", "She adopted a dirty stray dog from the shelter.", "The doctor examined her breast for lumps.", "He was fined for calling the clerk an idiot.", "The naked statue stands in the museum garden.",
    "Please keep your dog away from our sheep.", "The pig escaped from the farm and ran into the woods.", "Moderators deleted the comment because it insulted foreigners.", "The chess master will beat the champion in the final game.", "Foreigners are welcome in our town and bring good trade.", "They kissed goodbye at the station.",
    "The plague killed many people in the fourteenth century.", "Climbing the hill, he was panting like an old horse.", "It is wrong to call anyone worthless.",
    "Die Ratten wurden aus dem Keller vertrieben.", "Der Müll wird am Montag abgeholt.", "Das Schwein im Stall ist krank.", "Die Ausländer wurden herzlich begrüßt.", "Der Arzt untersuchte die Brust des Patienten.", "Der Kommentar wurde gelöscht, weil er beleidigend war.", "Im Theater spielte er einen Lügner.",
    "Halt dein Pferd an der Brücke an.", "Das nackte Felsgestein glänzte in der Sonne.", "Sie stöhnte unter der Last der Säcke.", "Die Fremden brachten Salz und Geschichten.", "Er schlug den Nagel in das Brett.", "Der Hund bellte die ganze Nacht.", "Man soll niemanden einen Idioten nennen, rügte der Lehrer.",
    "Le chat a chassé les rats du grenier.", "Les ordures sont ramassées le lundi.", "Le médecin examina le sein de la patiente.", "Les étrangers furent accueillis avec joie.", "Le commentaire insultant a été supprimé par les modérateurs.", "L'acteur jouait un menteur dans la pièce.", "La statue nue orne le jardin.",
    "Ferme la porte avant la nuit.", "Le chien a mordu le facteur.", "Elle gémit sous le poids du sac.", "Il a battu le tapis dans la cour.", "Le lit était défait et les draps sales.", "La peste ravagea la ville en hiver.", "Il aime l'amour des voyages et la mer.",
    "El gato echó a las ratas del granero.", "La basura se recoge los lunes.", "El médico examinó el pecho del paciente.", "Los extranjeros fueron recibidos con alegría.", "El comentario fue borrado por el moderador.", "El actor hacía el papel de mentiroso en el teatro.", "La estatua desnuda está en el museo.",
    "Cierra la puerta antes de salir.", "El perro ladró toda la noche.", "La plaga de langostas destruyó la cosecha.", "El cerdo se escapó de la granja.", "Se besaron en la estación y se despidieron.", "El gusano se come la manzana.", "No está bien llamar idiota a nadie, lo reprendió la maestra.",
    "Кошка прогнала крыс из амбара.", "Мусор вывозят по понедельникам.", "Врач осмотрел грудь пациента.", "Приезжих встретили хлебом и солью.", "Комментарий удалили за оскорбление.", "В театре он играл жалкого труса.", "Голая скала блестела на солнце.",
    "Свинья убежала с фермы.", "Собака лаяла всю ночь.", "Он бил молотом по железу.", "Чума опустошила город.", "Она стонала от боли в больнице.", "Закрой окно, дует.", "Учитель наказал его за слово дурак.",
    "猫把老鼠赶出了粮仓。", "垃圾每周一清理一次。", "大夫检查了病人的胸口。", "外乡人受到了村民的热情款待。", "评论里骂人的话已被管理员删除。", "他在戏里演一个骗子。", "美术馆里有一座赤裸的雕像。", "院子里的狗叫了一夜。", "那头猪从圈里跑了出来。",
    "瘟疫过后，村里人少了一半。", "他跑得太快，喘着气停下来。", "先生训斥他不该骂人白痴。", "孩子在温泉里光着身子玩水。", "他一棋打败了对手。", "母亲抱着孩子躺在床上。",
    "猫が倉から鼠を追い出した。", "ゴミは月曜日に収集される。", "医者は患者の胸を診察した。", "外国人は村で歓迎された。", "悪口のコメントは管理人に削除された。", "彼は芝居で嘘つきの役を演じた。", "美術館に裸の彫像がある。", "犬が一晩中吠えていた。", "豚が農場から逃げた。",
    "疫病が町を襲った。", "彼は走って喘いでいた。", "先生は彼がバカと言ったことを叱った。", "子供たちは温泉で裸になった。", "二人は駅で抱き合って別れた。",
]
