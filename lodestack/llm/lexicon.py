"""Words that tell personal information from look-alikes, by category and language.

All lists are fixed values: everyday words of six languages and common names of several cultures, none of them taken
from a corpus. A token is looked up lower-cased and without accents.
"""

from __future__ import annotations

# Words that stand near a phone number.
PHONE = """
tel telephone phone mobile cell call calls calling ring dial fax whatsapp sms text reach reached hotline landline extension ext number contact helpline pager
telefon telefonnummer handy mobil anruf anrufen rufen ruf rueckruf ruckruf rufnummer durchwahl festnetz erreichbar erreichen faxnummer
portable fixe appeler appelez appel joindre joignable rappeler numero telephoner poste
telefono movil llamar llame llama llamada celular fijo localizable marcar
тел телефон звоните звонить позвоните позвонить моб мобильный факс набрать связь звонок
"""
# Words that stand near a number of an identity document, a tax or a social-security number.
IDENTITY = """
id ssn passport security social insurance identity identification national tax licence license nino nhs taxpayer tin identifier document citizen personal
ausweis ausweisnummer personalausweis personalausweisnummer reisepass pass passnummer steuer steuernummer identifikationsnummer versicherungsnummer sozialversicherungsnummer rentenversicherung
passeport identite securite sociale nir insee fiscal carte sejour assure
dni nif nie pasaporte documento identidad seguridad cedula fiscal afiliacion
снилс паспорт паспорта паспорте инн удостоверение удостоверения полис серия документ
"""
# Words that stand near a street address.
ADDRESS = """
address lives live living moved resides residence located office deliver delivery ship shipping send mail visit home house at to near flat apartment
adresse anschrift wohnt wohnhaft wohne umgezogen lieferung liefern senden schicken ziehen sitz buro besuchen nach in an
habite habiter demeure domicile domicilie livrer livraison envoyer siege situe expedier au
direccion domicilio vive vivo reside enviar envio entregar entrega sede situado mudado en a
адрес адресу живет проживает доставка доставить отправить прописан находится офис переехал переехали
"""
# Words before the name of a person.
BEFORE_NAME = """
by from to with dear hi hello thanks regards sincerely cheers owner author contact contacts ask asked asking according reported signed manager colleague attn attention present attendees participants met meet called told via cc sender recipient employee patient customer reviewer assignee chair and said says written approved thank
von an mit lieber liebe hallo gruße grusse gruß gruss danke laut gemeldet verfasser kollege kollegin bearbeiter ansprechpartner ansprechpartnerin anwesend teilnehmer unterschrieben beauftragt und durch bei fur
par avec cher chere bonjour merci cordialement selon auteur signale collegue responsable presents participants signe et pour chez
por con estimado estimada hola gracias saludos segun autor aviso companero responsable asistentes firmado y para
от уважением сообщает сообщил сообщила автор ответственный ответственная присутствуют участники здравствуйте спасибо подписал коллега исполнитель и с по
"""
# Words after the name of a person.
AFTER_NAME = """
said says told asked wrote writes signed called reported found has is was will confirmed replied thinks works lives joined left approved sent noticed about and wants needs would can
hat ist sagt sagte schrieb bat sucht fand wird war meldete arbeitet wohnt unterschrieb bestatigte
a est dit ecrit cherche demande signale travaille habite confirme signe sera
ha es dijo escribio perdio busca firma trabaja vive confirmo aviso
сказал сказала написал написала просит ищет подписал подписала сообщил сообщила работает живет
"""
# Titles; they aren't part of a name.
TITLE = """
mr mrs ms miss dr prof sir madam mister doctor professor
herr herrn frau dipl ing
mme mlle monsieur madame docteur maitre
sr sra srta don dona senor senora
господин госпожа доктор профессор г-н г-жа
"""
# Words of firms, products, places and documents, which no person's name contains.
ORGANISATION = """
ltd llc inc corp corporation company co gmbh ag kg ohg sa sas sarl sl bv plc group holding holdings team department society association club university college school institute foundation bank hospital church museum library council
project product tool tools software system systems server service services suite pro edition version index search app studio cloud labs lab press journal news times magazine
street road lane avenue square park bridge lake river mountain valley island bay beach city town county state north south east west northern southern eastern western new old great upper lower central
chapter section part volume step phase table figure page appendix article room building floor gate
verein gesellschaft universitat schule abteilung firma verlag stiftung societe entreprise association universite ecole empresa sociedad universidad escuela ооо зао оао компания институт университет школа отдел
"""
# Everyday words that are capitalised at the start of a sentence or in titles.
COMMON = """
the a an this that these those it its we you they he she i my our your his her their there here if when while where why how what which who please note see try use open close check does do did is are was were has have had can could should would may must not no yes all any each every some many most more less in on at of for from to by with without about after before since until during as and or but so then also only just
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
der die das den dem des ein eine einen einem einer ich du er sie es wir ihr nicht kein keine ist sind war wenn weil wie was wer wo warum bitte auch nur noch schon alle jede jeder dieser diese dieses im am um zum zur nach seit bei ob uber vor
le la les un une des du de ce cette ces il elle nous vous ils on ne pas est sont dans sur pour avec sans apres avant depuis si quand comment pourquoi
el los las una uno del al este esta estos no se que en para con sin antes desde cuando como por
и в на не что это как для если когда почему после до или но мы вы он она они
"""
# Nouns before or after numbers that aren't personal.
COUNTED = """
order invoice ticket build version ver rev revision release room step page pages item items row rows line lines file files bytes kb mb gb part serial sku isbn issn port offset position checksum hash error code batch model case number no nr nº ref reference id: amount total price sum qty lot bug issue commit node frame sector block track parcel shipment tracking article
rechnung auftrag bestellung artikel seite zeile schritt ausgabe raum menge betrag fehler vorgang aktenzeichen sendung
facture commande article page ligne etape version salle montant erreur dossier colis
factura pedido articulo pagina linea paso version sala importe error expediente paquete
счет заказ версия страница строка шаг артикул сумма ошибка партия накладная
"""
# Lower-case parts of family names.
PARTICLE = "von van de der den du la le zu zum zur del della dos da di y ten ter bin al el ibn af av of und"
# Endings of file names.
FILE_TYPE = "png jpg jpeg gif svg webp txt md py rs js ts html css json csv xml yaml pdf docx xlsx pptx log zip gz tar exe dll so bin gguf onnx git"

# Common given names, a table for each culture.
GIVEN_ENGLISH = """
james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory frank alexander raymond patrick jack dennis jerry peter simon martin oscar victor edwin walter henry arthur harold hugh neil ian colin graham
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda dorothy melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela shirley anna brenda pamela emma nicole helen samantha katherine christine debra rachel carolyn janet catherine maria heather diane ruth julie olivia joyce virginia victoria kelly lauren christina joan evelyn judith megan alice clara nadia grace rose chloe lucy jane kate sophie hannah charlotte
"""
GIVEN_GERMAN = """
hans peter klaus wolfgang jurgen dieter manfred uwe gunter horst bernd karl heinz werner rainer stefan andreas thomas michael christian markus matthias jorg frank sven lars jens kai torsten thorsten holger dirk ralf bjorn florian sebastian tobias lukas jonas felix maximilian paul leon moritz ulrich gerhard friedrich ernst otto
ursula monika petra sabine karin renate helga brigitte ingrid erika christa gisela susanne andrea claudia birgit heike gabriele anja katrin kathrin silke tanja nicole melanie julia sandra stefanie katja anke annette anneliese lena lea hannah johanna franziska greta frieda elke marlies doris
"""
GIVEN_FRENCH = """
jean pierre michel andre philippe rene louis alain jacques bernard marcel daniel roger robert paul claude christian henri georges nicolas francois laurent julien thomas antoine guillaume mathieu maxime alexandre remi benoit olivier sebastien vincent luc hugo lucas etienne gilles yves thierry pascal didier
marie jeanne francoise monique catherine nathalie isabelle jacqueline anne sylvie martine madeleine nicole suzanne helene christine valerie sandrine stephanie celine chloe camille margaux manon lea emma juliette elodie aurelie virginie claire lucie pauline mathilde sophie brigitte genevieve
"""
GIVEN_SPANISH = """
antonio jose manuel francisco juan david javier daniel carlos jesus alejandro miguel rafael pedro pablo angel sergio fernando jorge luis alberto alvaro diego adrian raul enrique ramon vicente ivan ruben andres joaquin santiago inigo gonzalo hugo mateo eduardo ricardo
maria carmen ana isabel laura cristina marta dolores lucia pilar elena teresa rosa raquel paula sara mercedes beatriz rocio angeles silvia patricia irene begona nuria ines sofia alba ainhoa leire montserrat consuelo amparo encarnacion ximena
"""
GIVEN_RUSSIAN = """
александр сергей дмитрий андрей алексей максим евгений владимир иван михаил николай павел роман виктор олег игорь юрий константин антон денис артем вадим григорий борис глеб федор петр степан никита илья кирилл егор тимофей василий геннадий валерий леонид станислав вячеслав
анна мария елена ольга наталья наталия татьяна ирина светлана екатерина юлия людмила галина надежда марина любовь валентина нина вера тамара лариса оксана алла полина дарья ксения софия алина вероника анастасия евгения александра лидия зоя раиса
alexander sergey sergei dmitry andrey andrei alexey aleksei maxim evgeny vladimir ivan mikhail nikolai nikolay pavel igor yuri oleg boris gleb fyodor elena olga natalia natalya tatiana tatyana irina svetlana ekaterina yulia lyudmila galina anastasia ksenia
"""
GIVEN_OTHER = """
giovanni giuseppe marco luca andrea francesco alessandro matteo lorenzo paolo roberto stefano giulia chiara francesca federica elisa bianca
joao pedro tiago rui catarina ines beatriz piotr pawel krzysztof tomasz agnieszka katarzyna malgorzata jan willem pieter sanne femke lars erik anders ingrid astrid freya nils olof mikko aino
mohammed muhammad mohamed ahmed ali omar hassan hussein ibrahim yusuf khalid tariq karim fatima aisha khadija layla leila maryam zainab amina noor
priya rahul amit anil sanjay vijay ravi arjun rohan deepak suresh rajesh ananya neha pooja kavita sunita lakshmi divya meera anjali
wei ming jing li fang xiuying min jun lei yang yong jie tao chao hui ying xin yan hong mei hiroshi takeshi kenji yuki haruka sakura akira naoko minh anh linh thi min-jun ji-woo seo-yeon
kwame kofi ama chidi ngozi amara zanele thabo
"""
# Common family names.
FAMILY = """
smith jones taylor brown williams wilson johnson davies robinson wright thompson evans walker white roberts green hall wood jackson clarke miller davis garcia martinez rodriguez lopez gonzalez hernandez perez sanchez ramirez fernandez
muller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schroder neumann schwarz zimmermann braun
martin bernard dubois durand moreau laurent lefebvre leroy roux fournier girard bonnet dupont lambert
ivanov ivanova petrov petrova sidorov smirnov smirnova kuznetsov popov popova иванов иванова петров петрова сидоров смирнов смирнова кузнецов попов попова соколов лебедев новиков морозов волков
rossi russo ferrari esposito bianchi romano silva santos kowalski nowak wang zhang liu chen yang huang zhao wu zhou xu sun zhu lin kim lee park choi nguyen tran pham khan hussain ahmed singh patel kumar sharma gupta mehta
"""
# Words for streets, before or after the street's own name.
STREET_AFTER = "street st road rd lane ln avenue ave drive dr court ct close way terrace place pl hill row square sq crescent gardens boulevard blvd mews walk grove parade highway hwy parkway circle"
STREET_BEFORE_FR = "rue avenue boulevard bd impasse place chemin quai allée cours route square passage villa faubourg"
STREET_BEFORE = "Calle|C/|C\\.|Avda\\.?|Avenida|Av\\.|Plaza|Pza\\.?|Paseo|Camino|Ronda|Carrera|Travesía|Via|Viale|Piazza|Corso|Rua|улица|ул\\.|проспект|просп\\.|пр\\.|переулок|пер\\.|набережная|наб\\.|шоссе|бульвар|бул\\.|площадь|пл\\."
STREET_ENDINGS = "straße strasse str str. weg gasse platz allee ring damm ufer winkel hof markt steig pfad graben zeile chaussee stieg kamp berg tor brücke straat laan gracht"
STREET_AFTER_RU = "ул.|улица|пр.|проспект|пер.|переулок|наб.|набережная|шоссе|бульвар|пл.|площадь"

# Chinese surnames of one and of two characters.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟申欧耿关兰焦俞左柳祝鲍包成柏柯管"
COMPOUND = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 梁丘 左丘 东门 西门 南荣 第五"
# Characters frequent in Chinese given names.
GIVEN_HAN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂华建国志红玉梅辉鹏飞宇浩婷雪琳佳欣怡梓涵轩晨思雨子豪俊凯博文峰斌波鑫龙林海山川云月春秋冬晓小美玲燕萍莉颖洁慧琴珍凤莲荣光荣德福祥瑞康宁安庆东南西北天宏永成立新民生世振兴家嘉诗若语彤悦然馨蕾倩薇莹雯瑶琪璐雅清一泽睿航楠森源江河松柏青岚舟岩"
# Chinese words near personal information, and near look-alikes.
HAN_PHONE = "电话 手机 座机 致电 拨打 热线 联系电话 手机号 手机号码 电话号码 传真 来电 打电话 分机 固话 拨 联系方式"
HAN_IDENTITY = "身份证 身份证号 身份证号码 证件 证件号 证件号码 护照 护照号 社保号 社保 税号 纳税人 驾照"
HAN_ADDRESS = "地址 住址 住在 搬到 搬到了 搬至 寄到 寄至 寄往 送到 位于 地点 收货 家住 居住 迁到 迁至 办公地点 送货 到 在 至 了 往"
HAN_BEFORE_NAME = "由 请 向 给 与 和 跟 找 联系 联系人 作者 负责人 致 与会 出席 参加 通知 告知 同事 经理 感谢 谢谢 叫 叫做 姓名 名叫 收件人 客户 先生 女士 经 让 问 是 对 员工 病人 患者 主持人 签字 老师 对接人 编辑 记者 译者 校对 委托"
HAN_AFTER_NAME = "先生 女士 经理 老师 主任 同志 博士 教授 说 表示 负责 反馈 提交 处理 签字 认为 指出 告诉 发现 发来 写道 确认 回复 批准 报告 参加 主持 和 与 在 的 已 将 于 是 问 医生 工程师"
HAN_COUNTED = "订单 订单号 发票 编号 版本 步骤 第 单号 价格 金额 页 行 个 快递 流水号 批号 序列号"
# Everyday words that begin with a character that is also a surname, and words such a character ends.
HAN_WORDS = """
方案 方法 方式 方向 方面 方便 高亮 高级 高速 高度 高负 高兴 文件 文本 文档 文字 文章 时间 任务 任何 路径 于是 常用 常见 项目 金额 金融 石头 石油 白色 白天 云端 周期 周末 周报 周围 程序 程度 应用 关闭 关于 关系 关键 关注 易于 安装 安全 安排 包含 包括 包裹 成功 成为 成本 成员 单元 万一 余额 余下 计划 支持 全部 明天 申请 管理 管道 马上 马路 何时 何处 林业 江河 钱包 严重 严格 章节 温度 温馨 向上 向导 龙头 夏天 夏季 牛奶 毛病 毛巾 左侧 左边 石材 兰花 田地 田野 武器 施工 施行 康复 易错 段落 段时 莫名 顾客 顾问 雷达 史料 陆续 陆地 汤匙 许多 许可 何况 曾经 贺卡 黄色 黄金 金属 孔径 欧洲 齐全 戴上 庄园 焦点 祝福 成立 成绩 文化 安静 万元 江苏 于此 关机 关联 包装 包子 石板 严禁 陶瓷 胡同 杨树 马车 鲁莽 宋体 唐朝 秦朝 汉朝 明朝
经常 非常 通常 正常 异常 地方 对方 官方 双方 提高 最高 更高 语文 中文 英文 原文 正文 全文 公文 责任 信任 担任 现金 资金 基金 明白 空白 表白 属于 由于 对于 等于 小于 大于 多于 少于 高于 低于 位于 处于 相关 有关 机关 海关 方向 转向 倾向 面包 书包 钱包 压缩包 达成 完成 组成 生成 合成 形成 保管 主管 血管 容易 简易 交易 平安 西安 治安 手段 阶段 水温 体温 气温 长江 三万 千万 一万
"""
# Characters before a town in an address, and at the end of a town or street.
HAN_TOWN_ENDS = "省市县区镇乡州"
HAN_STREET_ENDS = "路 街 道 巷 弄 胡同 大道 大街 里"
