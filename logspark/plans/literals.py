"""Literal rows shared by queries and their SQL: (VALUES text, schema)."""

AGENTS = ("('agent-a',1,'h1',9092,100,200),('agent-b',2,'h2',9092,100,200),('agent-c',3,'h3',9092,100,120),('agent-d',2,'h4',9092,100,200),('agent-e',5,'h5',9092,100,200)", "agent string, node_id int, host string, port int, updated_at long, expires_at long")
ROUTING = ("('agent-a',1,'click',0,3),('agent-a',1,'view',1,1),('agent-b',2,'click',1,2),('agent-c',3,'click',2,9),('agent-d',2,'view',0,4),('agent-e',4,'view',2,7),('agent-b',2,'view',1,5)", "agent string, node_id int, topic string, partition int, epoch long")
UPLOADS = ("('gap',0,1,100,200),('gap',0,2,0,100),('stale',0,1,128,130),('real',0,1,128,130),('real',0,2,42,43),('chain',0,1,0,10),('chain',0,2,5,25),('chain',0,3,25,30),('chain',0,4,31,40)", "topic string, partition int, seq long, base long, end long")
BASELINE = ("('gap',0,0),('stale',0,128),('real',0,42),('chain',0,0)", "topic string, partition int, baseline long")
RULES = ("('alice','All','Topic','orders','Allow'),('alice','Write','Topic','orders','Deny'),('carol','Read','Topic',NULL,'Allow'),('*','Read','Topic','public','Allow'),('dave','All','Group','orders','Allow')", "principal string, operation string, kind string, name string, permission string")
ACCESS = ("(1,'alice','Write','Topic','orders'),(1,'alice','Read','Topic','orders'),(2,'alice','Read','Topic','orders'),(3,'ALICE','Read','Topic','orders'),(4,'alice','Read','Topic','orderz'),(5,'bob','Read','Topic','orders'),(6,'carol','Read','Topic','anything'),(7,'carol','Write','Topic','orders'),(8,'erin','Read','Topic','public'),(9,'dave','Read','Topic','orders'),(10,'dave','Read','Group','orders')", "request_id int, principal string, operation string, kind string, name string")
APPENDS = ("(1,'t',0,7,0,0,3),(2,'t',0,7,0,0,3),(3,'t',0,99,0,1,1),(4,'t',0,7,0,5,1),(5,'t',0,7,1,0,1),(6,'t',0,7,0,1,1),(7,'t',1,7,0,0,2),(8,'t',1,7,0,2,2)", "seq long, topic string, partition int, producer_id long, epoch int, base_seq int, n int")
GROUP_EVENTS = ("(1,0,'g','join','A',0,10000,5000),(2,10,'g','join','B',0,10000,5000),(3,20,'g','sync','A',1,10000,5000),(4,5000,'g','heartbeat','B',1,10000,5000),(5,12000,'g','heartbeat','B',1,10000,5000),(6,12500,'g','heartbeat','A',2,10000,5000),(7,40000,'g','tick','',0,0,0),(8,0,'h','join','X',0,100,0),(9,1900,'h','heartbeat','X',1,100,0),(10,2500,'h','leave','X',1,100,0)", "seq long, at_ms long, group_id string, event string, member_id string, generation int, session_ms int, rebalance_ms int")
SIZES = ("('30000000000',30000000000),('-1',-1),('30G',30000000000),('30GB',30000000000),('30Gb',30000000000),('30GiB',32212254720),('30gi',32212254720),('1.5GiB',1610612736),('0.5M',500000),('',NULL),('30X',NULL),('G',NULL),('30.',NULL),('30.5.5G',NULL),('-30G',NULL),('30 000',NULL),('30GBs',NULL)", "input string, expected long")
DURATIONS = ("('7d',604800000),('1w',604800000),('1.5d',129600000),('168h',604800000),('90m',5400000),('500ms',500),('250',250),('-5s',NULL),('x',NULL)", "input string, expected long")
NAMES = ("('00000000000000000042.log',42,0),('00000000000000000042-e7.log',42,7),('0-e1.log',0,1),('active.log',NULL,NULL),('00000000000000000042.index',NULL,NULL),('00000000000000000042.log.gz',NULL,NULL),('notanumber.log',NULL,NULL),('00000000000000000042-eseven.log',NULL,NULL),('noextension',NULL,NULL),('-e7.log',NULL,NULL)", "name string, base long, epoch long")
COUNTER = ("('c',0,0),('c',60,60),('c',120,120),('c',180,10),('c',240,70),('d',0,5),('d',60,5),('d',120,8)", "series string, ts long, value long")
MISSING = ("('s',0),('s',60),('s',120),('s',600),('s',660)", "series string, ts long")
STEPS = ("('s',0,1),('s',60,NULL),('s',120,NULL),('s',180,3),('s',240,4),('t',0,NULL),('t',60,1)", "series string, ts long, value long")
ALERT = ("('a',0,1),('a',60,1),('a',120,1),('a',180,0),('a',240,1),('a',300,1),('b',0,0),('b',60,5),('b',120,5),('b',180,5),('b',240,5)", "series string, ts long, value long")
MERGE = ("('t',0,1,100),('t',0,2,101),('t',0,3,110),('t',0,4,110),('t',0,5,105),('t',0,6,106)", "topic string, partition int, ord int, offset long")
ISLANDS = ("('t',0,0,99),('t',0,100,199),('t',0,200,299),('t',0,400,499),('t',0,500,599)", "topic string, partition int, first long, last_offset long")
MANIFEST = ("('t',0,10,0),('t',1,50,7)", "topic string, partition int, manifest_end long, manifest_start long")
OBJECTS = ("('t',0,20,0),('t',2,30,5)", "topic string, partition int, objects_end long, objects_start long")
REQUESTS = ("(1,1,'click',0,0,400,100000),(1,2,'click',1,5,1000000,100000),(2,1,'view',0,10,100000,300),(2,2,'view',1,0,100000,300),(3,1,'click',2,3,1,1000),(4,1,'nosuch',0,0,10,10),(5,1,'click',0,99999999,10,10),(6,1,'purchase',3,2,700,NULL)", "request_id int, ord int, topic string, partition int, fetch_offset long, partition_max_bytes long, max_bytes long")
KEYS = ("('a/0'),('a/1'),('b/0'),('group-000'),('group-001'),('orders/17'),('orders/18'),('x/1'),('x/2'),('x/3'),('group-002'),('group-003'),('group-017')", "key string")
TOPIC_REQUESTS = ("('click',4),('fresh',3),('zero',0)", "topic string, partitions int")
OFFSET_KEYS = ("('g/click/0'),('a/b/view/12'),('x/1'),('g/t/x')", "key string")
CLAIMS = ("(1,0,'t',0,'a',0),(2,10,'t',0,'b',0),(3,20,'t',0,'a',1),(4,40,'t',0,'a',0),(5,100,'t',0,'b',0),(6,110,'t',0,'a',1),(7,0,'t',1,'c',0)", "seq long, at long, topic string, partition int, agent string, held_epoch long")
