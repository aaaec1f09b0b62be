"""Fixed values that the results must follow, stated a second time so that the SQL does not lean on the code it checks."""

# Rules (name, expression, name hints, high risk), hints, regulations, placeholders, orders.
RULE_ROWS = (('email', '(?i:[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,})', ('email',), False),
 ('ip', '(?:\\d{1,3}\\.){3}\\d{1,3}', ('ip',), False),
 ('phone', '(?:\\+?1[-.\\s]?)?(?:\\(\\d{3}\\)|\\d{3})[-.\\s]?\\d{3}[-.\\s]?\\d{4}', ('phone', 'mobile'), False),
 ('ssn', '\\d{3}-?\\d{2}-?\\d{4}', ('ssn', 'social'), True),
 ('credit_card', '(?:\\d[ -]*?){13,19}', ('card', 'credit'), True),
 ('zip', '\\d{5}(-\\d{4})?', ('zip', 'postal'), False),
 ('dob', '(0?[1-9]|1[0-2])[/-](0?[1-9]|[12]\\d|3[01])[/-]\\d{4}', ('dob', 'birth'), False),
 ('driver_license', '[A-Z0-9]{6,12}', ('driver', 'license', 'dl'), False),
 ('passport', '[A-Z0-9]{8,9}', ('passport',), True),
 ('routing_number', '\\d{9}', ('routing',), False),
 ('bank_account', '\\d{8,17}', ('account', 'bank'), True),
 ('ein', '\\d{2}-\\d{7}', ('ein', 'tax'), False))
CANDIDATE_HINTS = ('name',
 'email',
 'phone',
 'ssn',
 'dob',
 'birth',
 'address',
 'zip',
 'postal',
 'account',
 'card',
 'customer',
 'employee',
 'user',
 'ip',
 'passport',
 'license',
 'driver',
 'tax',
 'tin',
 'ein',
 'routing',
 'bank',
 'iban')
ENTITY_PRIORITY_HINTS = ('name',
 'address',
 'street',
 'city',
 'location',
 'note',
 'notes',
 'narrative',
 'comment',
 'comments',
 'description',
 'message',
 'text')
REGULATIONS = (('email', 'GDPR', 'PII', 'Contact data needs a lawful basis and must be erasable on request.', 'MEDIUM'),
 ('email', 'CCPA', 'PII', 'Consumers may ask for disclosure and deletion of contact data.', 'MEDIUM'),
 ('phone', 'GDPR', 'PII', 'Contact data needs a lawful basis and must be erasable on request.', 'MEDIUM'),
 ('phone', 'CCPA', 'PII', 'Consumers may ask for disclosure and deletion of contact data.', 'MEDIUM'),
 ('ip', 'GDPR', 'Online identifier', 'Online identifiers count as personal data.', 'MEDIUM'),
 ('ip', 'CCPA', 'Online identifier', 'Online identifiers count as personal information.', 'MEDIUM'),
 ('ssn', 'CCPA', 'Sensitive Personal Data', 'Government identifiers must be secured and their use limited.', 'HIGH'),
 ('ssn', 'HIPAA', 'PHI', 'Social security numbers must be removed for de-identification.', 'HIGH'),
 ('credit_card',
  'CCPA',
  'Sensitive Personal Data',
  'Account access data must be secured and its use limited.',
  'HIGH'),
 ('credit_card', 'GDPR', 'PII', 'Payment data needs appropriate technical protection.', 'HIGH'),
 ('zip', 'HIPAA', 'PHI', 'Geographic units below a state must be generalised for de-identification.', 'LOW'),
 ('dob', 'HIPAA', 'PHI', 'Dates of birth must be reduced to the year for de-identification.', 'HIGH'),
 ('dob', 'GDPR', 'PII', 'Birth dates need a lawful basis and minimisation.', 'MEDIUM'),
 ('driver_license',
  'CCPA',
  'Sensitive Personal Data',
  'Government identifiers must be secured and their use limited.',
  'HIGH'),
 ('driver_license', 'HIPAA', 'PHI', 'Licence numbers must be removed for de-identification.', 'HIGH'),
 ('passport',
  'CCPA',
  'Sensitive Personal Data',
  'Government identifiers must be secured and their use limited.',
  'HIGH'),
 ('passport', 'GDPR', 'PII', 'National identifiers need appropriate technical protection.', 'HIGH'),
 ('routing_number', 'CCPA', 'PII', 'Financial account data must be secured.', 'MEDIUM'),
 ('bank_account',
  'CCPA',
  'Sensitive Personal Data',
  'Account access data must be secured and its use limited.',
  'HIGH'),
 ('bank_account', 'HIPAA', 'PHI', 'Account numbers must be removed for de-identification.', 'HIGH'),
 ('ein', 'CCPA', 'PII', 'Tax identifiers of sole traders count as personal information.', 'LOW'),
 ('PERSON', 'GDPR', 'PII', 'Names need a lawful basis and must be erasable on request.', 'MEDIUM'),
 ('PERSON', 'HIPAA', 'PHI', 'Names must be removed for de-identification.', 'HIGH'),
 ('LOCATION', 'HIPAA', 'PHI', 'Geographic units below a state must be generalised for de-identification.', 'MEDIUM'),
 ('LOCATION', 'GDPR', 'PII', 'Location data needs a lawful basis.', 'MEDIUM'),
 ('EMAIL_ADDRESS', 'GDPR', 'PII', 'Contact data needs a lawful basis and must be erasable on request.', 'MEDIUM'),
 ('PHONE_NUMBER', 'GDPR', 'PII', 'Contact data needs a lawful basis and must be erasable on request.', 'MEDIUM'),
 ('US_SSN', 'HIPAA', 'PHI', 'Social security numbers must be removed for de-identification.', 'HIGH'),
 ('CREDIT_CARD', 'GDPR', 'PII', 'Payment data needs appropriate technical protection.', 'HIGH'),
 ('IP_ADDRESS', 'GDPR', 'Online identifier', 'Online identifiers count as personal data.', 'MEDIUM'),
 ('UK_NHS', 'GDPR', 'Health data', 'Health identifiers need explicit consent or another special basis.', 'HIGH'))
PLACEHOLDERS = ('nan',
 'n/a',
 'na',
 'none',
 'null',
 'nil',
 'tbd',
 'tba',
 'todo',
 'unknown',
 '-',
 '--',
 '?',
 'xxx',
 'test',
 'placeholder')
PATTERN_PRIORITY = {'LOCATION': 10,
 'PERSON': 20,
 'EMAIL_ADDRESS': 30,
 'PHONE_NUMBER': 40,
 'email': 50,
 'phone': 60,
 'ssn': 70,
 'zip': 80,
 'DATE_TIME': 90,
 'URL': 100}
RISK_LEVELS = ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'REVIEW')
